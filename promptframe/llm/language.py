"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of bytes in both directions, gives every position a distribution over
the languages, and a document's prediction is the mean over all its positions. It is trained here,
in numpy, by backpropagation through time, on a sample of labelled documents: ``per_language``
distinct ids of each language (those of the lowest digests) and ``windows`` windows of each are kept
before anything is collected, so at most ``per_language * windows`` windows of ``window`` bytes a
language come to the driver, however often an id is repeated.
Every labelled language is learned; more labels than ``MAX_LANGUAGES`` are an error, as they are no
languages. Prediction reads whole texts.

A text that is null or has no letter is ``und`` with score 0. Ties go to the first language in
name order. Repeated rows get the same result; other columns are never inputs. If no labelled
text is there to learn from, every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptframe.llm.registry import query, table

UNKNOWN = "und"
#: More labels than this are taken for something else than languages, which is an error.
MAX_LANGUAGES = 1000


@dataclass(frozen=True)
class Settings:
    """Sizes of the sample, the network and its training."""

    per_language: int = 400
    windows: int = 4
    window: int = 96
    hidden: int = 8
    epochs: int = 5
    batch: int = 128
    rate: float = 0.02
    seed: int = 7


def _squash(x: np.ndarray) -> np.ndarray:
    """The softsign, a cheap stand-in for the hyperbolic tangent; gates are half of one plus it."""
    return x / (np.abs(x) + 1)


def _slope(y: np.ndarray) -> np.ndarray:
    """The derivative of the softsign where its value is ``y``."""
    return (1 - np.abs(y)) ** 2


class Direction:
    """One gated recurrent layer: update gate, reset gate and candidate side by side."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.hidden = hidden
        self.params = {
            "byte": rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32),
            "state": rng.normal(0, hidden ** -0.5, (hidden, 3 * hidden)).astype(np.float32)}

    def forward(self, steps: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, list]:
        """States (time, window, hidden) of ``steps`` (time, window); a state starts anew at padding."""
        h = self.hidden
        byte, state = self.params["byte"], self.params["state"]
        now, out, kept = np.zeros((steps.shape[1], h), np.float32), [], []
        for x, real in zip(steps, here, strict=True):
            a, b = byte[x], now @ state
            gates = 0.5 * (_squash(a[:, :2 * h] + b[:, :2 * h]) + 1)
            z, r = gates[:, :h], gates[:, h:]
            n = _squash(a[:, 2 * h:] + r * b[:, 2 * h:])
            new = (n + z * (now - n)) * real[:, None]
            kept.append((x, now, z, r, n, b[:, 2 * h:], real))
            now = new
            out.append(now)
        return np.stack(out), kept

    def backward(self, kept: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the parameters from those of the states, back through time."""
        h, state = self.hidden, self.params["state"]
        grad = {k: np.zeros_like(v) for k, v in self.params.items()}
        d_now = np.zeros_like(d_out[0])
        for (x, before, z, r, n, bn, real), d in zip(kept[::-1], d_out[::-1], strict=True):
            d_new = (d + d_now) * real[:, None]
            d_n = d_new * (1 - z) * _slope(n)
            d_z = d_new * (before - n) * 0.5 * _slope(2 * z - 1)
            d_r = d_n * bn * 0.5 * _slope(2 * r - 1)
            d_a = np.concatenate([d_z, d_r, d_n], 1)
            d_b = np.concatenate([d_z, d_r, d_n * r], 1)
            np.add.at(grad["byte"], x, d_a)
            grad["state"] += before.T @ d_b
            d_now = d_new * z + d_b @ state.T
        return grad


class Network:
    """Both directions and a softmax over the languages at every position."""

    def __init__(self, languages: list[str], settings: Settings):
        rng = np.random.default_rng(settings.seed)
        self.languages, self.window = languages, settings.window
        self.ahead, self.back = Direction(settings.hidden, rng), Direction(settings.hidden, rng)
        self.out = {"weight": rng.normal(0, 0.3, (2 * settings.hidden, len(languages))).astype(np.float32),
                    "bias": np.zeros(len(languages), np.float32)}

    def positions(self, steps: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Probabilities (time, window, language)."""
        f, kept_f = self.ahead.forward(steps, here)
        b, kept_b = self.back.forward(steps[::-1], here[::-1])
        both = np.concatenate([f, b[::-1]], 2)
        logits = both @ self.out["weight"] + self.out["bias"]
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        return p, (both, kept_f, kept_b)

    def gradients(self, steps: np.ndarray, here: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """The mean cross entropy of all positions, and its gradients by parameter."""
        p, (both, kept_f, kept_b) = self.positions(steps, here)
        total = here.sum()
        rows = np.arange(steps.shape[1])
        loss = float(-(np.log(p[:, rows, label] + 1e-9) * here).sum() / total)
        d = p
        d[:, rows, label] -= 1
        d *= here[:, :, None] / total
        d_both = d @ self.out["weight"].T
        h = self.ahead.hidden
        flat = both.reshape(-1, both.shape[2]).T @ d.reshape(-1, d.shape[2])
        grads = {("out", "weight"): flat, ("out", "bias"): d.sum((0, 1))}
        grads |= {("ahead", k): v for k, v in self.ahead.backward(kept_f, d_both[:, :, :h]).items()}
        grads |= {("back", k): v for k, v in self.back.backward(kept_b, d_both[::-1, :, h:]).items()}
        return loss, grads

    def parameter(self, key: tuple[str, str]) -> np.ndarray:
        part = getattr(self, key[0])
        return (part if isinstance(part, dict) else part.params)[key[1]]

    def train(self, windows: list[bytes], labels: list[int], settings: Settings) -> None:
        """Adam over shuffled batches, with a falling rate."""
        rng = np.random.default_rng(settings.seed)
        label = np.array(labels)
        moments: dict = {}
        starts = [s for _ in range(settings.epochs) for s in range(0, len(label), settings.batch)]
        for k, s in enumerate(starts, 1):
            if s == 0:
                order = rng.permutation(len(label))
            pick = order[s:s + settings.batch]
            _, grads = self.gradients(*padded([windows[i] for i in pick], settings.window), label[pick])
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            rate = settings.rate * (1 - 0.9 * k / len(starts))
            for key, g in grads.items():
                g = g / max(1.0, size)
                m, v = moments.get(key, (0.0, 0.0))
                moments[key] = m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                step = rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
                self.parameter(key)[...] -= step.astype(np.float32)

    def pooled(self, texts: list[bytes], group: int = 1536) -> np.ndarray:
        """Mean probabilities (text, language) over all bytes of each text; zeros for an empty one."""
        w = self.window
        group = max(1, group * 64 // max(64, len(self.languages)))  # the same memory with many languages
        windows = [(k, t[s:s + w]) for k, t in enumerate(texts) for s in range(0, len(t), w)]
        total = np.zeros((len(texts), len(self.languages)))
        for s in range(0, len(windows), group):
            part = windows[s:s + group]
            steps, here = padded([t for _, t in part], w)
            np.add.at(total, [k for k, _ in part], self.window_sums(steps, here))
        return total / np.maximum(1, [len(t) for t in texts])[:, None]

    def window_sums(self, steps: np.ndarray, here: np.ndarray) -> np.ndarray:
        """Probabilities (window, language) summed over the positions of each window.

        The same network as ``positions``, without what training keeps: features are rows, so that
        every operation runs over contiguous windows.
        """
        h, n = self.ahead.hidden, steps.shape[1]
        a, b, c = (np.empty((3 * h, n), np.float32) for _ in range(3))
        seen = np.empty((len(steps), len(self.languages), n), np.float32)
        total = np.zeros((len(self.languages), n), np.float32)
        for layer, order, ahead in ((self.ahead, range(len(steps)), True),
                                    (self.back, range(len(steps) - 1, -1, -1), False)):
            byte = np.ascontiguousarray(layer.params["byte"].T)
            # a gate is half of one plus its squashed sum: the reset gate's half is in the weights
            state = layer.params["state"].T * np.repeat(np.float32([1, 1, 0.5]), h)[:, None]
            weight = np.ascontiguousarray(self.out["weight"][:h] if ahead else self.out["weight"][h:]).T.copy()
            now, new = np.zeros((h, n), np.float32), np.empty((h, n), np.float32)
            for t in order:
                np.take(byte, steps[t], axis=1, out=a, mode="clip")
                np.matmul(state, now, out=b)
                gates = a[:2 * h]
                gates += b[:2 * h]
                np.abs(gates, out=c[:2 * h])
                c[:2 * h] += 1
                gates /= c[:2 * h]
                gates += 1
                np.multiply(gates[h:], b[2 * h:], out=new)
                new += a[2 * h:]
                np.abs(new, out=c[2 * h:])
                c[2 * h:] += 1
                new /= c[2 * h:]
                now -= new
                now *= gates[:h]
                now *= 0.5
                now += new
                if ahead:
                    np.matmul(weight, now, out=seen[t])
                    continue
                now *= here[t]
                p = seen[t]
                p += weight @ now
                p += self.out["bias"][:, None]
                p -= p.max(0)
                np.exp(p, out=p)
                p *= here[t] / p.sum(0)
                total += p
        return total.T

def padded(windows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (time, window) and 1.0 where they are real."""
    flat = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in windows), np.uint8).reshape(-1, width)
    here = np.arange(width)[None, :] < np.array([len(t) for t in windows])[:, None]
    return np.ascontiguousarray(flat.T), np.ascontiguousarray(here.T).astype(np.float32)


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of documents that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _letters(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          settings: Settings = Settings()) -> Network:
    """A network trained on a bounded sample of the labelled documents that are not held out."""
    labelled = docs.select(
        F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"),
        F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held")
    ).filter("lang IS NOT NULL AND id IS NOT NULL AND NOT held").filter(_letters(F.col("text")))
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("id").alias("ids")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels in {lang_col}: these are no languages")
    languages = sorted(r["lang"] for r in counts)
    windows, labels = [], []
    if languages:
        # a draw of four times the ids that are kept, so that only these are shuffled; the lowest digests are in it
        share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], 4 * settings.per_language / r["ids"])])
        draw = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
        chosen = labelled.withColumn("draw", draw).filter(F.col("draw") < F.try_element_at(share, F.col("lang")))
        place = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.greatest(
            F.length("text") - settings.window, F.lit(0)) + 1)
        cut = F.array(*[F.substring(F.col("text"), (place(k) + 1).cast("int"), F.lit(settings.window))
                        for k in range(settings.windows)])
        distinct = chosen.select("lang", "id", "draw", cut.alias("cut")).groupBy("lang", "id", "draw").agg(
            F.min("cut").alias("cut"))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))
        kept = distinct.withColumn("rank", rank).filter(F.col("rank") <= settings.per_language)
        for lang, _, cuts in sorted((r["lang"], r["id"], r["cut"]) for r in kept.select("lang", "id", "cut").collect()):
            parts = {c.encode("utf-8", "replace")[:settings.window] for c in cuts}
            windows += sorted(parts)
            labels += [languages.index(lang)] * len(parts)
    network = Network(sorted(set(languages)) if windows else [], settings)
    if windows:
        network.train(windows, labels, settings)
    return network


def prediction(network: Network, text: Column) -> Column:
    """A struct of the language and its score for a text column."""
    batch = 1 << 20

    @F.pandas_udf("lang string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            langs, scores, held, size = [], [], [], 0

            def flush() -> None:
                p = network.pooled(held)
                best = p.argmax(1)
                langs.extend(network.languages[k] for k in best)
                scores.extend(np.clip(p.max(1), 0, 1).tolist())

            for t in part:
                held.append(t.encode("utf-8", "replace"))
                size += len(held[-1])
                if size > batch:
                    flush()
                    held, size = [], 0
            if held:
                flush()
            yield pd.DataFrame({"lang": langs, "score": scores})

    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if not network.languages:
        return unknown
    # texts without letters reach the network as empty ones
    readable = F.coalesce(_letters(text), F.lit(False))
    got = predict(F.when(readable, text).otherwise(F.lit("")))
    return F.when(readable, got).otherwise(unknown)


def identify(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, held_out, lang_pred and score of every row."""
    rows = docs.select(docs[id_col].alias(id_col), held_out(id_col).alias("held_out"),
                       F.col(text_col).cast("string").alias("_text"))
    out = rows.select(id_col, "held_out", prediction(network, F.col("_text")).alias("_p"))
    return out.select(id_col, "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))


def keep_known(docs: DataFrame, network: Network, text_col: str = "text", min_score: float = 0.4,
               lang_col: str | None = None) -> DataFrame:
    """The rows whose language is known with at least ``min_score``, with the columns they came with.

    With ``lang_col``, rows without a label there get the predicted one.
    """
    whole = docs.select(F.struct("*").alias("_row"))
    told = whole.select("_row", prediction(network, F.col(f"_row.`{text_col}`")).alias("_p"))
    kept = told.filter((F.col("_p.lang") != UNKNOWN) & (F.col("_p.score") >= min_score))
    if lang_col is not None:
        label = F.coalesce(F.col(f"_row.`{lang_col}`"), F.col("_p.lang").cast(docs.schema[lang_col].dataType))
        kept = kept.select(F.col("_row").withField(f"`{lang_col}`", label).alias("_row"))
    return kept.select("_row.*")


@query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
