"""Spelling variants of words: pairs one edit apart, found by a variable-length gram index.

1. *Dictionary.* Of all grams of the distinct words those of a share of all words and more are
   frequent. A gram starts with ``shortest`` characters and is extended while it is frequent, up to
   ``longest``; so rare grams stay short and frequent ones become selective. Only frequent grams are
   told to the tasks, and their share bounds how many there can be.
2. *Decomposition.* A word, with an end mark on each side, is the list of its grams by position,
   without those that lie inside the gram before.
3. *Bounds.* One edit can touch the grams around its place, and, right of it, those that a gram across
   its place may newly cover, which needs a frequent gram that ends as the word goes on there. The
   worst place gives the word's number of affected grams, the rest is what it shares at least with any
   word one edit away: of two words, the larger of both numbers.
4. *Merging.* What one edit leaves are the first and the last grams of a word. So lists of grams are
   merged under the keys (first a grams, last b grams), with a + b from the word's own bound up to all
   but one; two words meet only at a + b = the larger bound of both.
5. *Verification* of every pair that meets, in the join itself.

Words have no null and are distinct; a word needs ``2 * longest - 2`` characters, which leaves every
word a bound of one gram at least. Code points count, whatever their script.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptframe.llm.registry import query, table, text_or_empty, written


@dataclass(frozen=True)
class Settings:
    """Parameters of the index; none of them changes which pairs are found."""

    shortest: int = 2
    longest: int = 4
    #: A gram of more than this share of all words is frequent.
    frequent: float = 0.0005


SETTINGS = Settings()
#: End marks; words hold neither.
FIRST, LAST = "\x02", "\x03"
#: Maximal runs of these make words.
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def frequent_grams(words: DataFrame, settings: Settings = SETTINGS) -> frozenset[str]:
    """The frequent grams of the column ``word``, each with its first characters frequent, too.

    A word has fewer than its length of them, so their number stays below the mean length over the share.
    """
    marked = words.select(F.concat(F.lit(FIRST), "word", F.lit(LAST)).alias("w")).withColumn("_l", F.length("w"))
    grams = [F.transform(F.sequence(F.lit(1), F.col("_l") - (q - 1)), lambda p, q=q: F.substring("w", p, F.lit(q)))
             for q in range(settings.shortest, settings.longest)]
    if not grams:
        return frozenset()
    least = settings.frequent * words.count()
    counted = marked.filter(F.col("_l") >= settings.longest).select(F.explode(F.concat(*grams)).alias("g"))
    often = {r["g"] for r in counted.groupBy("g").count().filter(F.col("count") > least).collect()}
    return frozenset(g for g in often if all(g[:k] in often for k in range(settings.shortest, len(g))))


class Grams:
    """Decomposition and bounds under a dictionary of frequent grams."""

    def __init__(self, frequent: frozenset[str], settings: Settings = SETTINGS):
        self.frequent, self.shortest, self.longest = frequent, settings.shortest, settings.longest
        # what a gram may hold after the place of an edit, without its last character
        self.inner = frozenset(g[k:] for g in frequent for k in range(1, len(g) + 1))

    def split(self, marked: str) -> list[tuple[int, int]]:
        """Begin and end of the grams of a marked word."""
        out, covered, n = [], 0, len(marked)
        for p in range(n - self.shortest + 1):
            e = p + self.shortest
            while e < n and e - p < self.longest and marked[p:e] in self.frequent:
                e += 1
            if e > covered:
                out.append((p, e))
                covered = e
        return out

    def affected(self, marked: str, grams: list[tuple[int, int]]) -> int:
        """The most grams that one edit can touch; place 0 stands for a character put after the first mark."""
        most = 0
        for i in range(len(marked) - 1):
            touched = 0
            for p, e in grams:
                if p <= i < e:
                    touched += i > 0 or e > 1
                elif p > i and marked[i + 1:e - 1] in self.inner:
                    touched += 1
            most = max(most, touched)
        return most

    def keys(self, word: str) -> tuple[int, list[str], list[int]]:
        """The word's bound, and the keys under which its lists are merged, each with its number of grams."""
        marked = FIRST + word + LAST
        grams = self.split(marked)
        n = len(grams)
        bound = n - self.affected(marked, grams)
        left = ["", *(marked[:e] for _, e in grams)]
        right = [*(marked[p:] for p, _ in grams), ""]
        keys, levels = [], []
        for j in range(bound, n):
            keys += [f"{left[a]}\x00{right[n - j + a]}" for a in range(j + 1)]
            levels += [j] * (j + 1)
        return bound, keys, levels


def postings(words: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """word, n, bound, level and key of every list in which a word (word, n) stands."""
    grams = Grams(frequent_grams(words, settings), settings)
    least = 2 * settings.longest - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, keys, levels, ends = [], [], [], [0]
            for word in batch.column(0).to_pylist():
                if len(word) < least:
                    raise ValueError(f"words need {least} characters")
                bound, own, at = grams.keys(word)
                bounds.append(bound)
                keys += own
                levels += at
                ends.append(len(keys))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(bounds, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(levels, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(keys, pa.string()))],
                names=["word", "n", "bound", "level", "key"])

    lists = words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(
        run, "word string, n long, bound int, level array<int>, key array<string>")
    return lists.select("word", "n", "bound", F.explode(F.arrays_zip("level", "key")).alias("_k")).select(
        "word", "n", "bound", "_k.level", F.xxhash64("_k.key").alias("key"))


def near_pairs(words: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """a, n_a, b, n_b: every two words (word, n) of edit distance one, once, a before b."""
    lists = postings(words, settings)
    a = lists.select(*[F.col(c).alias(f"a_{c}") for c in lists.columns])
    b = lists.select(*[F.col(c).alias(f"b_{c}") for c in lists.columns])
    same = (F.col("a_key") == F.col("b_key")) & (F.col("a_level") == F.col("b_level"))
    admitted = (F.col("a_word") < F.col("b_word")) & (F.col("a_level") == F.greatest("a_bound", "b_bound"))
    admitted &= F.abs(F.length("a_word") - F.length("b_word")) <= 1
    met = a.join(b.hint("merge"), same & admitted & (F.levenshtein("a_word", "b_word", 1) == 1))
    return met.select(F.col("a_word").alias("a"), F.col("a_n").alias("n_a"), F.col("b_word").alias("b"),
                      F.col("b_n").alias("n_b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and root: where the chain of forms (word, form) that starts at a word ends.

    A form is followed to twice the distance in each round. Forms have no cycle.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        far = now.select(F.col("word").alias("_w"), F.col("root").alias("_far"))
        met = now.join(far, now["root"] == far["_w"], "left")
        if met.filter("_far IS NOT NULL").isEmpty():
            return now
        now = written(met.select("word", F.coalesce("_far", "root").alias("root")), "variant-roots")


def group_variants(words: DataFrame, times: int = 10, settings: Settings = SETTINGS) -> DataFrame:
    """word, n, n_near, form, form_n and root of every distinct word (word, n).

    A word's form is its most frequent near word (of equals the smallest), if that is ``times`` as
    frequent; its root is the end of the chain of forms.
    """
    words = written(words, "variant-words")
    pairs = written(near_pairs(words, settings), "variant-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n")))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("_best"))
    enough = -F.col("_best.less") >= times * F.col("n")
    told = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("_best.near")).alias("form"),
        F.when(enough, -F.col("_best.less")).alias("form_n")), "variant-forms")
    rooted = roots(told.filter("form IS NOT NULL"))
    return told.join(rooted, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 7,
                 least_n: int = 2, misspell: int = 31) -> DataFrame:
    """word and n of all words of the texts, lower-cased (A-Z only).

    Of one run of letters in ``misspell``, chosen with the place by a digest of document and run, one
    character is left out, as a source of known misspellings (0: none). A null id counts as empty.
    """
    runs = docs.select(
        F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate(text_or_empty(text_col), UPPER, LOWER),
                                       F.lit(f"{LETTERS}{{{least_chars},}}"), F.lit(0))).alias("run"))

    def without(run: Column, place: Column) -> Column:
        return F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.length(run)))

    word = F.col("run")
    if misspell:
        hashed = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
        place = F.pmod(F.col("h"), F.length("run")).cast("int")
        runs = hashed.withColumn("run", F.when(F.col("h") % misspell == 0, without(word, place)).otherwise(word))
    return runs.filter(F.length("run") >= least_chars).groupBy(word.alias("word")).agg(
        F.count("*").alias("n")).filter(F.col("n") >= least_n)


@query()
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of ``documents`` with its near words' number, its form and its root."""
    return group_variants(corpus_words(table(spark, sf_dir, "documents")))
