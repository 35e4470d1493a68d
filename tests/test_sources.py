import base64
import json

import pytest
from pyspark.sql import functions as F

from promptframe.operators import tables
from promptframe.sources import files
from promptframe.sources.ordinals import dense_ordinals, read_parquet_group, with_ordinals
from promptframe.sources.project import Project


def listed(df):
    return [tuple(r)[1:] for r in df.orderBy("_ord").collect()]


def write(path, text, **kw):
    path.write_text(text, encoding=kw.get("encoding", "utf-8"), newline="")
    return str(path)


def test_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'city,country\nParis,France\nBerlin,\n,Germany\nNA,"a\nb ""q"""\n007,1.50\n')
    df = files.read_csv_group(spark, path)
    assert listed(df) == [("Paris", "France"), ("Berlin", None), (None, "Germany"), (None, 'a\nb "q"'), ("007", "1.50")]
    assert [f.dataType.simpleString() for f in df.schema.fields[1:]] == ["string", "string"]
    semi = write(tmp_path / "b.csv", "a;b\né;2\n", encoding="latin-1")
    assert listed(files.read_csv_group(spark, semi, sep=";", encoding="latin-1")) == [("é", "2")]
    other = write(tmp_path / "c.txt", "“é”\nx", encoding="cp1252")
    assert listed(files.read_lines_group(spark, other, "v", encoding="cp1252")) == [("“é”",), ("x",)]
    wide = write(tmp_path / "d.txt", "é\r\n\nx\n", encoding="utf-16")
    assert listed(files.read_lines_group(spark, wide, "v", encoding="utf-16")) == [("é",), ("",), ("x",)]


def test_lines(spark, tmp_path):
    path = write(tmp_path / "data.txt", " data1\n\ndata3\t\r\nlast")
    assert listed(files.read_group(spark, path)) == [("data1",), ("",), ("data3",), ("last",)]
    assert files.read_group(spark, path).columns == ["_ord", "data"]


def test_json_lines_keep_number_text(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"b": 1, "a": 2.50, "c": true}\n{"b": 2, "a": 1, "d": [1, 2]}\n')
    df = files.read_jsonl_group(spark, path).select("_ord", "a", "b", "c", "d")
    assert listed(df) == [("2.5", 1, True, None), ("1", 2, None, "[1,2]")]


def test_json_array(spark, tmp_path):
    good = write(tmp_path / "a.json", json.dumps([{"city": "Paris", "country": "France"}, {"city": "Berlin", "country": None}]))
    assert listed(files.read_json_group(spark, good)) == [("Paris", "France"), ("Berlin", None)]
    with pytest.raises(ValueError, match="list of objects"):
        files.read_json_group(spark, write(tmp_path / "b.json", '{"a": 1}'))


def test_pasted_text(spark):
    assert listed(files.group_from_string(spark, " a \n\nb", "txt")) == [("a",), ("",), ("b",)]
    assert listed(files.group_from_string(spark, "x,y\n1,\nNA,2", "csv")) == [("1", None), (None, "2")]
    assert listed(files.group_from_string(spark, '{"a": 1}\n{"a": 2, "b": "z"}', "jsonl")) == [(1, None), (2, "z")]
    assert listed(files.group_from_string(spark, '[{"a": 1.5}, {"a": 2}]', "json")) == [("1.5",), ("2",)]
    with pytest.raises(ValueError):
        files.group_from_string(spark, '{"a": 1}', "json")


def test_directory(spark, tmp_path):
    for i in (1, 2, 3):
        write(tmp_path / f"file{i}.txt", f"héllo\r\nworld {i}")
    write(tmp_path / "skip.md", "no")
    assert listed(files.read_directory_group(spark, str(tmp_path))) == [
        (f"file{i}.txt", f"héllo\nworld {i}", 13) for i in (1, 2, 3)]
    parts = listed(files.read_directory_group(spark, str(tmp_path), split_length=5))
    assert parts[:3] == [("file1.txt_part_000", "héllo", 5), ("file1.txt_part_001", "\nworl", 5), ("file1.txt_part_002", "d 1", 3)]
    last = listed(files.read_directory_group(spark, str(tmp_path), split_length=5, split_count=-1))
    assert [p[0] for p in last] == [f"file{i}.txt_part_002" for i in (1, 2, 3)]
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(ValueError, match="bad.txt"):
        files.read_directory_group(spark, str(tmp_path))


def test_images(spark, tmp_path):
    data = bytes(range(256)) * 2
    (tmp_path / "a.PNG").write_bytes(data)
    (tmp_path / "b.webp").write_bytes(b"x")
    got = listed(files.read_image_group(spark, str(tmp_path)))
    assert got == [("a.PNG", f"[data:image/png;base64,{base64.b64encode(data).decode()}]", 512),
                   ("b.webp", "[data:image/webp;base64,eA==]", 1)]


def test_split_matches_slices(spark):
    texts = ["", "abc", "abcdef", "abcdefg", "é😀x" * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    got = {}
    for r in files.split_fixed(df, "k", "t", 3).orderBy("_part").collect():
        got.setdefault(r["_id"].split("_")[0], []).append(r["document_text"])
    assert got == {str(i): [t[a:a + 3] for a in range(0, len(t), 3)] or [""] for i, t in enumerate(texts)}


def test_generator(spark):
    df = files.group_from_generator(spark, lambda: [{"a": "x", "b": 1}, {"a": "y"}], "a string, b int")
    assert listed(df) == [("x", 1), ("y", None)]
    many = files.group_from_generator(spark, lambda i, n: ({"a": f"{i}/{j}"} for j in range(i)), "a string", 4)
    assert listed(many) == [("1/0",), ("2/0",), ("2/1",), ("3/0",), ("3/1",), ("3/2",)]


def test_row_cap(spark):
    df = files.group_from_rows(spark, [{"id": i} for i in range(51)])
    assert files.require_max_rows(df, 51) is df
    with pytest.raises(ValueError, match="50"):
        files.require_max_rows(df, 50)


def test_ordinals_over_many_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 7).write.parquet(path)
    got = read_parquet_group(spark, path).orderBy("_ord").collect()
    assert [(r["_ord"], r["id"]) for r in got] == [(i, i) for i in range(1000)]
    text = str(tmp_path / "lines")
    spark.range(0, 500, 1, 5).select(F.col("id").cast("string")).write.text(text)
    assert listed(files.read_lines_group(spark, text, "v")) == [(str(i),) for i in range(500)]


def test_ordinals_of_many_blocks(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 100, 1, 7).write.parquet(path)
    got = read_parquet_group(spark, path).orderBy("_ord").collect()
    assert [(r["_ord"], r["id"]) for r in got] == [(i, i) for i in range(100)]


def test_ordered_by_keys(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    got = with_ordinals(df, "k", F.desc("id")).orderBy("_ord").collect()
    want = sorted(((i % 3, i) for i in range(100)), key=lambda t: (t[0], -t[1]))
    assert [(r["k"], r["id"]) for r in got] == want and [r["_ord"] for r in got] == list(range(100))


def test_equal_keys_are_spread(spark):
    df = spark.range(20_000).withColumn("k", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(-1)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    group = with_ordinals(df, "k")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files_used = group.select(F.spark_partition_id()).distinct().count()
    largest = max(r["count"] for r in group.groupBy(F.spark_partition_id()).count().collect())
    assert files_used > 1 and largest < 13_000  # two thirds of the rows share a key
    rows = group.orderBy("_ord").collect()
    assert [r["id"] for r in rows[:13_333]] == [i for i in range(20_000) if i % 3]


def test_reader_by_suffix(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_group(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="suffix"):
        files.read_group(spark, write(tmp_path / "a.xyz", "x"))


# --- projects -------------------------------------------------------------------------

PROJECT = {
    "metadata": {"file_format_version": "2.0"},
    "parameters": {"w": [{"word": "dog"}, {"word": "cat", "n": 1}]},
    "prompts": {"a": "Translate {{word}}", "b": "{{n}}"},
    "runs": {"r": {"module_id": "m", "module_name": "M", "module_args": {"x": 1}}},
    "disabled_prompts": ["b"],
}


def test_project(spark, tmp_path):
    project = Project.load(spark, write(tmp_path / "p.pbp", json.dumps(PROJECT)))
    assert project.enabled_prompts == {"a": "Translate {{word}}"} and project.rag == {}
    assert listed(project.groups["w"]) == [("dog", None), ("cat", 1)]
    assert project.runs["r"].args == {"x": 1}
    more = project.with_group("w", write(tmp_path / "new.txt", "fox"))
    assert listed(more.groups["w"]) == [("fox",)] and more.groups["w"].columns == ["_ord", "w"]
    project.validate_runs({"m"})
    with pytest.raises(ValueError):
        project.validate_runs({"x"})
    with pytest.raises(ValueError, match="ordinals"):
        project.with_group("z", spark.range(3))
    with pytest.raises(ValueError, match="newer"):
        Project.from_dict(spark, {"metadata": {"file_format_version": "9.0"}})


def test_old_project(spark):
    old = {"metadata": {"file_format_version": "0.9"}, "parameters": [[{"x": 1}]],
           "prompts": ['Say {x} as {{"v": {x}}}', "{y}"]}
    project = Project.from_dict(spark, old)
    assert list(project.groups) == ["Parameter 0"]
    assert project.prompts == {"Prompt 0": 'Say {{x}} as {"v": {{x}}}', "Prompt 1": "{{y}}"}


# --- table edits ----------------------------------------------------------------------


@pytest.fixture
def table(spark):
    return files.group_from_rows(spark, [
        {"_id": "1", "a": "x", "b": None}, {"_id": "1", "a": "x", "b": None}, {"_id": "2", "a": None, "b": 5}])


def test_edits(table):
    assert listed(tables.truncate(table, 1)) == [("1", "x", None)]
    once = tables.remove_duplicates(table)
    assert [r["_ord"] for r in once.orderBy("_ord").collect()] == [0, 2]
    assert [r["_ord"] for r in tables.close_ordinals(once).orderBy("_ord").collect()] == [0, 1]
    assert tables.rename_variable(table, "a", "z").columns == ["_ord", "_id", "b", "z"]
    assert listed(tables.drop_variable(table.drop("_id"), "b")) == [("x",), ("x",)]
    assert tables.drop_variable(table.select("_ord", "a"), "a").count() == 0


def test_close_ordinals_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(tables, "BLOCK_ROWS", 16)
    sparse = spark.range(1000).select(F.col("id").alias("_ord"), "id").filter("id % 7 = 3 or id > 900")
    got = tables.close_ordinals(sparse).orderBy("_ord").collect()
    want = [i for i in range(1000) if i % 7 == 3 or i > 900]
    assert [(r["_ord"], r["id"]) for r in got] == list(enumerate(want))


def test_transform(table):
    by_columns = tables.transform_rows(table, lambda d: {"a": F.upper("a"), "n": F.length("_id")})
    assert [r["a"] for r in by_columns.orderBy("_ord").collect()] == ["X", "X", None]
    by_rows = tables.transform_rows(table, lambda row: {"note": f"{row['_id']}!"}, "note string")
    assert [r["note"] for r in by_rows.orderBy("_ord").collect()] == ["1!", "1!", "2!"]


def test_preview(spark):
    df = files.group_from_rows(spark, [{"t": "x" * 60, "n": i} for i in range(60)])
    got = tables.preview(df).orderBy("_ord").collect()
    assert len(got) == 50 and got[0]["t"] == "x" * 50 + "..." and got[11]["n"] == "11"
    assert got[0]["text_length"] == 61


def test_rows_survive_another_split_of_their_files(spark, tmp_path):
    from promptframe.sources.files import read_lines_group

    path = tmp_path / "lines.txt"
    path.write_text("".join(f"line {k}\n" for k in range(40_000)))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes")
            if spark.conf.get(k, None) is not None}
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "16")
        group = read_lines_group(spark, str(path), "line")
        spark.conf.set("spark.sql.files.minPartitionNum", "7")
        rows = group.collect()
    finally:
        for k in ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes"):
            spark.conf.set(k, kept[k]) if k in kept else spark.conf.unset(k)
    assert sorted((r._ord, r.line) for r in rows) == [(k, f"line {k}") for k in range(40_000)]


def test_ragged_rows_and_mixed_headers(spark, tmp_path):
    from promptframe.sources.files import read_csv_group

    short = tmp_path / "short.csv"
    short.write_text('a,b\n1\n"x,y","p\nq"\n')
    assert [tuple(r)[1:] for r in read_csv_group(spark, str(short)).orderBy("_ord").collect()] == [
        ("1", None), ("x,y", "p\nq")]
    long = tmp_path / "long.csv"
    long.write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="more than 2 fields"):
        read_csv_group(spark, str(long)).collect()
    mixed = tmp_path / "mixed.csv"
    mixed.mkdir()
    (mixed / "1.csv").write_text("a,b\n1,2\n")
    (mixed / "2.csv").write_text("b,a\n20,10\n")
    with pytest.raises(Exception):
        read_csv_group(spark, str(mixed)).collect()


@pytest.mark.parametrize("encoding", ["utf-16", "utf-8-sig", "utf-8"])
def test_a_json_list_in_any_encoding(spark, tmp_path, encoding):
    from promptframe.sources.files import read_json_group

    path = tmp_path / "rows.json"
    path.write_bytes('  [{"a": "é"}, {"a": "y"}]'.encode(encoding))
    assert [r.a for r in read_json_group(spark, str(path), encoding.removesuffix("-sig")).orderBy("_ord").collect()] == ["é", "y"]
    path.write_bytes('{"a": 1}'.encode(encoding))
    with pytest.raises(ValueError, match="list of objects"):
        read_json_group(spark, str(path), encoding.removesuffix("-sig"))


def test_generator_as_a_stream(spark, tmp_path):
    name = files.generator_format(spark, lambda i, n: ({"a": f"{i}/{j}"} for j in range(i)), "a string", 5, per_batch=2)
    job = (spark.readStream.format(name).load().writeStream.format("parquet").option("path", str(tmp_path / "out"))
           .option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="0 seconds").start())
    want = sorted((i, j, f"{i}/{j}") for i in range(5) for j in range(i))
    try:
        job.processAllAvailable()
        assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
    finally:
        job.stop()
    assert sorted(tuple(r) for r in spark.read.format(name).load().collect()) == want


@pytest.mark.parametrize("multi_line", [True, False])
@pytest.mark.parametrize("line", ["3,4,", "3,4,5", '"3","4",""', "3,4,,", '3,"4",\r'])
def test_csv_rows_with_more_fields_are_errors(spark, tmp_path, line, multi_line):
    (tmp_path / "t.csv").write_text(f"a,b\n1,2\n{line}\n5,6\n")
    with pytest.raises(Exception, match="more than 2 fields"):
        files.read_csv_group(spark, str(tmp_path / "t.csv"), multi_line=multi_line).collect()


def test_csv_rows_with_fewer_fields_end_in_nulls(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c\n1,2,3\n4\n5,"x, y"\n,,\n')
    rows = files.read_csv_group(spark, str(tmp_path / "t.csv")).orderBy("_ord").collect()
    assert [tuple(r)[1:] for r in rows] == [("1", "2", "3"), ("4", None, None), ("5", "x, y", None), (None, None, None)]


def test_many_blocks_are_numbered_by_buckets(spark):
    blocks = spark.range(3000).select(
        F.format_string("f%05d", F.col("id")).alias("_name"), F.explode(F.sequence(F.lit(0), F.col("id") % 4)).alias("_at"))
    df = blocks.withColumn("v", F.concat("_name", F.lit("/"), F.col("_at").cast("string"))).repartition(5, "v")
    numbered = dense_ordinals(df.withColumn("_at", F.col("_at") + 7), ["_name"], "_at")
    want = [f"f{k:05d}/{j}" for k in range(3000) for j in range(k % 4 + 1)]
    assert [r.v for r in numbered.orderBy("_ord").collect()] == want
    assert [r[0] for r in numbered.select("_ord").orderBy("_ord").collect()] == list(range(len(want)))
    assert "SinglePartition" not in numbered._jdf.queryExecution().toString()
    assert dense_ordinals(df.limit(0), ["_name"], "_at").count() == 0


def test_files_of_a_query_grow_with_its_table(spark):
    """A CSV file is one task's work, so the folder has a file for each split of the table."""
    from promptframe.plans.grid_queries import _sorted

    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = _sorted(spark, "/root/testdata/sf0.001", "documents", "doc_id")
        ids = rows.select("doc_id", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows.rdd.getNumPartitions() > 12
    assert [r["doc_id"] for r in sorted(ids, key=lambda r: r["p"])] == sorted(r["doc_id"] for r in ids)


ODD_FILES = {
    "b_mark": b"\xef\xbb\xbf", "c_marked": b"\xef\xbb\xbfab\ncd", "d_ended": b"one\r\ntwo\r\n",
    "e_returns": b"x\ry\r\rz\r", "f_blank": b"\n\n\r\n", "g_mark_ended": b"\xef\xbb\xbf\n", "h_long": "né𝄞 ".encode() * 400,
    "i_lines": "".join(f"línea {k}\n" * (k % 7) for k in range(300)).encode(), "j_return": b"\r", "k_one": b"\n"}


@pytest.mark.parametrize("length, count", [(7, None), (50, 2), (50, -2), (10_000, None)])
def test_text_files_are_read_by_lines(spark, tmp_path, length, count):
    """Same parts as of files held as a whole, over many splits of a file."""
    for name, content in ODD_FILES.items():
        (tmp_path / f"{name}.txt").write_bytes(content)
    want = []
    for name in sorted(ODD_FILES):
        text = ODD_FILES[name].decode().replace("\r\n", "\n").replace("\r", "\n")
        parts = [text[k:k + length] for k in range(0, max(len(text), 1), length)]
        named = [(f"{name}.txt_part_{k:03d}" if len(text) > length else f"{name}.txt", p, len(p)) for k, p in enumerate(parts)]
        want += named if count is None else named[:count] if count > 0 else named[count:]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        found = files.read_directory_group(spark, str(tmp_path), split_length=length, split_count=count)
        rows = found.orderBy("_ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["_id"], r["document_text"], r["document_size"]) for r in rows] == want
    assert [r["_ord"] for r in rows] == list(range(len(want)))


def test_text_files_are_not_held_as_a_whole(spark, tmp_path):
    write(tmp_path / "a.txt", "one\ntwo\n")
    found = files.read_directory_group(spark, str(tmp_path), encoding="latin-1", split_length=3)
    assert [r["document_text"] for r in found.orderBy("_ord").collect()] == ["one", "\ntw", "o\n"]
    assert "decode(content" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_python_workers_get_batches_of_bounded_bytes(spark):
    import pandas as pd

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [len(batch)]})

    rows = spark.range(0, 100, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    found = [r["n"] for r in rows.mapInPandas(sizes, "n bigint").collect()]
    assert sum(found) == 100 and max(found) < 20
    group = rows.select(F.lit(0).cast("long").alias("_ord"), "text")
    long = tables.transform_rows(group, lambda row: {"n": len(row["text"])}, "n bigint")
    assert long.agg(F.sum("n"), F.count("*")).first()[:] == (100 << 20, 100)


def test_heads_of_json_files_are_looked_at_by_tasks(spark, tmp_path, monkeypatch):
    """The driver opens no file: no call of its own for each of many."""
    for k in range(3):
        (tmp_path / f"{k}.json").write_bytes(b"\xef\xbb\xbf" * (k == 1) + b' \n[{"a": %d}]' % k)
    monkeypatch.setattr(files, "first_bytes", lambda *a: 1 / 0, raising=False)
    rows = files.read_json_group(spark, str(tmp_path)).orderBy("_ord").collect()
    assert [(r["_ord"], r["a"]) for r in rows] == [(0, 0), (1, 1), (2, 2)]
    (tmp_path / "3.json").write_text('{"a": 3}')
    with pytest.raises(ValueError, match="list of objects"):
        files.read_json_group(spark, str(tmp_path))
