"""Language identification (operator 10).

Averaged hashed subword embeddings with a linear softmax, trained by
stochastic gradient descent in numpy. Subwords are runs of 2, 3 and 4 code
points of the lower-cased text, in which everything that is not a letter is
one word gap. A temperature fitted on documents apart from the training rows
calibrates the score; below a threshold set on the same documents the
prediction is rejected.

Prediction needs only the product of embeddings and output weights, a table of
one row of logits for each hash, averaged over a text's subwords: whole texts
are read, in blocks of bounded size.

Defined results: null texts and texts without letters are ``und`` with score 0
and are rejected; without any labelled row every text is ``und``; null
languages are never learned from; of languages that score alike the first by
name wins; a very long text is read in blocks; ids may be of any type, repeat,
or be null (a null id is not
held out and not learned from); further columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.common import fresh

BUCKETS = 1 << 15
DIM = 16
GRAMS = (2, 3, 4)
#: The bounded sample of labelled rows that the model is fitted on, for each language.
ROWS_PER_LANGUAGE = 400
#: No text whose calibrated score is above this is rejected.
MOST_THRESHOLD = 0.55
BLOCK = 1 << 20

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def letters_and_gaps(text: str) -> np.ndarray:
    """Code points of the lower-cased text with one 32 for each run of others, and one at either end; empty without letters."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letter_table()[code]
    if not is_letter.any():
        return np.empty(0, dtype=np.uint32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    code = np.where(is_letter, code, 32)[keep].astype(np.uint32)
    head = np.array([32], dtype=np.uint32)
    return np.concatenate((head, code, head) if code[-1] != 32 else (head, code))


def hashes(code: np.ndarray, n: int, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of each run of n code points."""
    m = len(code) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.int64)
    h = np.full(m, n, dtype=np.uint32)
    for i in range(n):
        h = (h ^ code[i : i + m]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h & np.uint32(buckets - 1)).astype(np.int64)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares of its subwords."""
    code = letters_and_gaps(text or "")
    if not len(code):
        return np.empty(0, dtype=np.int64), np.empty(0)
    total = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(code), BLOCK):
        for n in GRAMS:
            total += np.bincount(hashes(code[at : at + BLOCK + n - 1], n), minlength=BUCKETS)
    ids = np.flatnonzero(total)
    return ids, total[ids] / total.sum()


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # one row a bucket
    bias: np.ndarray
    temperature: float
    threshold: float

    def score(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated score, whether it is rejected)."""
        code = letters_and_gaps(text or "")
        if not len(code) or not self.languages:
            return "und", 0.0, True
        total, n_all = np.zeros(len(self.languages)), 0
        for at in range(0, len(code), BLOCK):
            for n in GRAMS:
                h = hashes(code[at : at + BLOCK + n - 1], n)
                if len(h):
                    if len(h) > 4096:  # the table is then smaller than what would be gathered
                        total += np.bincount(h, minlength=len(self.logits)) @ self.logits
                    else:
                        total += self.logits[h].sum(0, dtype=np.float64)
                    n_all += len(h)
        z = (total / max(n_all, 1) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        best = int(np.argmax(e))
        p = float(e[best] / e.sum())
        return self.languages[best], p, p < self.threshold


def fitted(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 4.0, seed: int = 1) -> Model:
    """Train on (language, buckets, shares); every fifth row only calibrates. With fewer than 50 rows all do both, as a tenth of so few would say nothing."""
    rows = [r for r in rows if len(r[1])]
    languages = sorted({r[0] for r in rows})
    if not rows:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)
    index = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM
    out, bias = np.zeros((DIM, len(languages))), np.zeros(len(languages))
    train = [r for i, r in enumerate(rows) if i % 5 or len(rows) < 50]
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            lang, ids, share = train[i]
            lr = rate * (1 - done / steps)
            done += 1
            hidden = share @ emb[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[index[lang]] -= 1
            back = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= 0.1 * lr * p
            emb[ids] -= lr * share[:, None] * back
    logits = emb @ out
    held = [r for i, r in enumerate(rows) if not i % 5] if len(rows) >= 50 else rows
    z = np.array([r[2] @ logits[r[1]] + bias for r in held])
    y = np.array([index[r[0]] for r in held])

    def loss(t: float) -> float:
        a = z / t
        a = a - a.max(1, keepdims=True)
        return float(-(a[np.arange(len(y)), y] - np.log(np.exp(a).sum(1))).mean())

    t = min(np.geomspace(0.05, 5, 60), key=loss)
    a = np.exp(z / t - (z / t).max(1, keepdims=True))
    right = (a / a.sum(1, keepdims=True)).max(1)[a.argmax(1) == y]
    threshold = min(MOST_THRESHOLD, float(np.quantile(right, 0.002)) if len(right) else 1.0)
    return Model(languages, logits.astype(np.float32), bias, float(t), threshold)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit on a sample of at most about ``per_language`` labelled rows of each language.

    A row is in the sample if the hash of its id and text is below its language's
    rate, so nothing is ranked or gathered beyond the sample, and one id for many
    rows is no matter. Rows that are equal in id, text and language count as one.
    Executors turn sampled texts into subword shares; those come to the driver.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    (mark,) = fresh(usable, "mark")
    usable = usable.withColumn(mark, F.xxhash64(F.lit(7), "doc_id", "text"))
    n_of = {r[0]: r[1] for r in usable.select("lang", mark).distinct().groupBy("lang").count().collect()}
    if not n_of:
        return fitted([])
    rate = F.lit(0.0)
    for lang, n in n_of.items():
        rate = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(rate)
    u = F.pmod(mark, F.lit(1 << 30)) / float(1 << 30)
    picked = usable.where(u < rate).select(F.col(mark).alias("mark"), "lang", "text").dropDuplicates(["mark", "lang"])

    def shares(batches):
        for b in batches:
            got = [counted(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("mark"), b.column("lang"), pa.array([x[0].astype(np.int32) for x in got], pa.list_(pa.int32())), pa.array([x[1].astype(np.float32) for x in got], pa.list_(pa.float32()))],
                names=["mark", "lang", "ids", "share"],
            )

    got = picked.mapInArrow(shares, "mark long, lang string, ids array<int>, share array<float>").toArrow()
    mark, langs = got["mark"].to_numpy(), got["lang"].to_pylist()
    ids, share = (got[c].combine_chunks() for c in ("ids", "share"))
    ends = ids.offsets.to_numpy()
    ids, share = ids.values.to_numpy(), share.values.to_numpy()  # as they came: no list of Python numbers
    order = sorted(range(len(mark)), key=lambda i: (mark[i], langs[i]))
    return fitted([(langs[i], ids[ends[i] : ends[i + 1]].astype(np.int64), share[ends[i] : ends[i + 1]].astype(np.float64)) for i in order])


def identified(docs: DataFrame, model: Model | None = None, carry: tuple[str, ...] | None = None) -> DataFrame:
    """Predictions for every whole text: the carried columns, ``__lang, __score, __rejected``."""
    model = model or trained(docs)
    carry = list(carry or ["doc_id"])
    if {c.lower() for c in carry} & {"__lang", "__score", "__rejected"}:
        raise ValueError("__lang, __score and __rejected are what is returned; rename the carried columns")
    names = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(F.col("text").alias("t"), *[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)])
    fields = ", ".join(f"{n} {dict(rows.dtypes)[n]}" for n in names)

    def predict(batches):
        for b in batches:
            got = [model.score(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.bool_())],
                names=[*b.schema.names[1:], "l", "s", "r"],
            )

    out = rows.mapInArrow(predict, f"{fields}, l string, s double, r boolean")
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], F.col("l").alias("__lang"), F.col("s").alias("__score"), F.col("r").alias("__rejected"))


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents with their own columns, without those whose language is rejected."""
    model = model or trained(docs)

    def keep(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            yield b.filter(pa.array([not model.score(t.as_py())[2] for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
