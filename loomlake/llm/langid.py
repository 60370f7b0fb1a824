"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 10).

Training takes at most TRAIN_ROWS whole texts a language, chosen by a hash of doc_id, and counts their
character 1-, 2- and 3-grams in 2**16 hash buckets; the log-probabilities (languages x buckets) are
broadcast, and each task scores whole texts with numpy, a bounded piece at a time. Counts are a written
table; of more than LANGUAGES languages, texts are scored against one block of them after another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlake.llm.common import checked, hash60, written

BUCKETS = 1 << 16
#: Texts a language that training reads at most, and tasks among which they are dealt.
TRAIN_ROWS, TRAIN_TASKS = 2000, 8
#: Languages that texts are scored against at once, so that what is broadcast has so many rows of BUCKETS floats at most (64 MB).
LANGUAGES = 256
#: Characters that a task scores at once.
PIECE = 1 << 20
#: The pipeline's stage keeps documents whose language has at least this probability.
LEAST_SCORE = 0.5
_LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text is 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(codes: np.ndarray) -> list[np.ndarray]:
    """Hash buckets of the 1-, 2- and 3-grams that start at each place of codes (0 ends a text)."""
    c = codes.astype(np.uint32)
    n1, n2 = np.append(c[1:], np.uint32(0)), np.append(c[2:], np.zeros(min(2, len(c)), np.uint32))[: len(c)]
    mix = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64)
    one = c * np.uint32(0x9E3779B1)
    two = (one ^ n1) * np.uint32(0x85EBCA77) + np.uint32(1)
    three = (two ^ n2) * np.uint32(0xC2B2AE3D) + np.uint32(2)
    return [mix(one), mix(two), mix(three)]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' lower-cased code points, each text between a space and a 0, and where each begins."""
    padded = [" " + t.lower().replace("\0", " ") + " \0" for t in texts]
    starts = np.cumsum([0, *map(len, padded[:-1])]) if padded else np.zeros(0, int)
    return np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def _pieces(text: str) -> Iterator[str]:
    for at in range(0, len(text), PIECE):
        yield text[at : at + PIECE]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
            mine = counts.setdefault(lang, np.zeros(BUCKETS))
            for piece in _pieces(text):
                codes, _ = _codes([piece])
                for g in grams(codes):
                    mine += np.bincount(g, minlength=BUCKETS)
    yield pa.RecordBatch.from_pydict({"lang": list(counts), "counts": [x.astype("<f4").tobytes() for x in counts.values()]}, schema=pa.schema([("lang", pa.string()), ("counts", pa.binary())]))


def _added(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), "<f4").astype(float) for x in rows["counts"])
    return pa.table({"lang": rows["lang"][:1], "counts": pa.array([total.astype("<f4").tobytes()], pa.binary())})


class Model:
    """Counts of every language that documents not held out are labelled with, as a table with the languages' numbers in order."""

    def __init__(self, docs: DataFrame) -> None:
        labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
        sizes = written(labelled.groupBy("lang").agg(F.count("*").alias("n")), "langid-sizes")
        below = sizes.select(F.col("lang").alias("_l"), (F.least(F.lit(1.0), F.lit(float(TRAIN_ROWS)) / F.col("n")) * float(1 << 60)).alias("below"))
        sample = labelled.join(checked(below), F.col("lang") == F.col("_l")).where(hash60(F.col("doc_id")) < F.col("below")).select("lang", "text")
        counted = sample.repartition(TRAIN_TASKS).mapInArrow(_count, "lang string, counts binary").groupBy("lang").applyInArrow(_added, "lang string, counts binary")
        number = (F.row_number().over(Window.orderBy("lang")) - 1).cast("int")  # one row a language
        self.table = written(sizes.withColumn("number", number).join(counted, "lang", "left"), "langid-counts")
        self.total = self.table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.blocks = -(-self.table.count() // LANGUAGES)

    def block(self, k: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The languages of a block, their log priors, and log P(bucket | language)."""
        rows = self.table.where(F.col("number").between(k * LANGUAGES, (k + 1) * LANGUAGES - 1)).orderBy("number").collect()  # LANGUAGES rows at most
        counts = np.full((len(rows), BUCKETS), 0.5)
        for i, r in enumerate(rows):
            if r["counts"]:
                counts[i] += np.frombuffer(r["counts"], "<f4")
        prior = np.log(np.array([r["n"] for r in rows], float) / self.total) if rows else np.zeros(0)
        return [r["lang"] for r in rows], prior, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def scores(texts: list[str], prior: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """log P(language) + log P(text | language), a row a text; long texts go piece by piece."""
    out = np.tile(prior, (len(texts), 1))
    group: list[tuple[int, str]] = []

    def flush() -> None:
        codes, starts = _codes([t for _, t in group])
        who = np.array([i for i, _ in group])
        for g in grams(codes):
            for k in range(len(prior)):
                np.add.at(out[:, k], who, np.add.reduceat(logp[k][g], starts, dtype=np.float64))
        group.clear()

    size = 0
    for i, t in enumerate(texts):
        for piece in _pieces(t):
            group.append((i, piece))
            size += len(piece)
            if size >= PIECE:
                flush()
                size = 0
    if group:
        flush()
    return out


#: What goes from one block of languages to the next: the best language so far, its log probability, and the logarithm of the sum of all.
_SO_FAR = ("__langid_lang", "__langid_best", "__langid_all")


def _predictor(model, first: bool, last: bool, out: str):
    """Scores batches against a block of languages; at last adds lang_pred and score (out: "predict"), or keeps the rows whose language is sure ("keep")."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, logp = model.value
        for b in batches:
            texts = b["text"].to_pylist()
            n = len(texts)
            pred, best, every = ([None] * n, np.full(n, -np.inf), np.full(n, -np.inf)) if first else (b[_SO_FAR[0]].to_pylist(), *(b[c].to_numpy().copy() for c in _SO_FAR[1:]))
            at = [i for i, t in enumerate(texts) if langs and t and _LETTER.search(t)]
            if at:
                s = scores([texts[i] for i in at], prior, logp)
                top, most = s.argmax(1), s.max(1)
                for i, k, m, total in zip(at, top, most, most + np.log(np.exp(s - most[:, None]).sum(1)), strict=True):
                    if m > best[i]:
                        pred[i], best[i] = langs[k], m
                    every[i] = np.logaddexp(every[i], total)
            own = {c: b[c] for c in b.schema.names if c not in _SO_FAR}
            if not last:
                yield pa.RecordBatch.from_pydict({**own, **dict(zip(_SO_FAR, (pa.array(pred, pa.string()), pa.array(best), pa.array(every)), strict=True))})
                continue
            known = np.array([p is not None for p in pred], bool)
            score = np.zeros(n)
            score[known] = np.minimum(1.0, np.exp(best[known] - every[known]))
            if out == "keep":
                yield pa.RecordBatch.from_pydict(own).filter(pa.array(known & (score >= LEAST_SCORE)))
            else:
                del own["text"]
                yield pa.RecordBatch.from_pydict({**own, "lang_pred": pa.array([p or "und" for p in pred], pa.string()), "score": pa.array(score)})

    return run


def _scored(docs: DataFrame, model: Model, schema: T.StructType, out: str) -> DataFrame:
    blocks = max(1, model.blocks)
    between = T.StructType([*docs.schema, T.StructField(_SO_FAR[0], T.StringType()), *[T.StructField(c, T.DoubleType()) for c in _SO_FAR[1:]]])
    for k in range(blocks):
        own = docs.sparkSession.sparkContext.broadcast(model.block(k))
        last = k == blocks - 1
        docs = docs.mapInArrow(_predictor(own, k == 0, last, out), schema if last else between)
        if not last:  # the next block's broadcast takes this one's place
            docs = written(docs, "langid-scored")
    return docs


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    Null texts and texts without a letter are und with score 0, and so is every text if there is no
    labelled row to learn from. Texts of any length are scored whole, a piece at a time. Null doc_ids are
    not held out; repeated rows are predicted alike; ties go to the language that sorts first; an empty
    table gives no rows; other columns are not read. score is the posterior probability of lang_pred.
    """
    model = Model(docs)
    slim = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    schema = T.StructType([*[f for f in slim.schema if f.name != "text"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return _scored(slim, model, schema, "predict")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is recognised with LEAST_SCORE or more, with the columns of docs.

    Null and empty texts and those without a letter go, as their language is und, and so do all if no row
    has a label; nulls in other columns, repeated rows and very long texts are kept or not by their text.
    """
    return _scored(docs, Model(docs), docs.schema, "keep")
