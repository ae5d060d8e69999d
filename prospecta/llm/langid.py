"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and every run of characters that are not letters becomes one space. Each n-gram of the
ORDERS is hashed to one of BUCKETS features. The model is one log-probability per feature and language, a
matrix of fixed size that is broadcast; a block of texts is scored from the features that occur in it.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Rows with a null language,
null id or held-out id teach nothing. With no rows to learn from every text is ``und``. Ties between
languages go to the one that sorts first. Repeated rows are scored alike. Other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospecta.llm.heldout import bounded_sample, held_out
from prospecta.llm.textblocks import row_blocks, trimmed

ORDERS, BUCKETS, SMOOTHING = (2, 3), 1 << 16, 0.5
#: At most about so many labelled documents are learned from, whatever the table's size.
TRAIN_DOCS = 20_000
#: Languages that a model can have, which bounds the matrix (0.25 MB each); with more in the sample training is refused.
MAX_LANGUAGES = 1000
#: Languages whose counts a task holds at once.
HELD_LANGUAGES = 64
UNKNOWN = "und"
#: How many deviations of its language's training n-grams a text's mean may lie below theirs: so many, and so many over the
#: root of its n-grams (each character is in five n-grams, so 10 is about 4.5 standard errors).
FLOOR_SPREADS, FLOOR_ERRORS = 1.25, 10.0


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> itself for letters, 32 for all else."""
    table = np.arange(0x110000, dtype=np.uint32)
    other = [c for c in range(0x110000) if 0xD800 <= c < 0xE000 or not chr(c).isalpha()]
    table[other] = 32
    return table


def features(texts: list[str], orders=ORDERS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature of every n-gram, text by text; how many each text has; whether a text has a letter)."""
    low = [t.lower() for t in texts]
    points = _letters()[np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1)
    owner_start = np.concatenate([[0], ends[:-1]])
    space = points == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    keep[owner_start] = True
    keep[ends - 1] |= True
    place = np.cumsum(keep) - 1
    points = points[keep].astype(np.uint64)
    start, stop = place[owner_start], place[ends - 1] + 1
    lettered = np.add.reduceat((points != 32).astype(np.int64), start) > 0 if len(texts) else np.zeros(0, bool)
    size = stop - start
    rolled = points * np.uint64(0x9E3779B97F4A7C15)
    mixed, ids = np.zeros(len(points), np.uint64), np.zeros((len(orders), len(points)), np.int32)
    fits = np.zeros((len(orders), len(points)), bool)
    left = np.repeat(stop, size) - np.arange(len(points)) if len(points) else np.zeros(0, np.int64)
    for n in range(1, max(orders) + 1):
        shifted = np.concatenate([rolled[n - 1 :], np.zeros(n - 1, np.uint64)])[: len(points)]
        mixed = (mixed ^ shifted) * np.uint64(0xC2B2AE3D27D4EB4F)
        if n in orders:
            k = orders.index(n)
            ids[k] = ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(13)).astype(np.int64) & (buckets - 1)
            fits[k] = left >= n
    ids, fits = ids.T.ravel(), fits.T.ravel()
    counts = np.add.reduceat(fits.astype(np.int64), start * len(orders)) if len(texts) else np.zeros(0, np.int64)
    return ids[fits], counts, lettered


def train(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", bound=TRAIN_DOCS):
    """(languages, log-probability matrix [BUCKETS, languages], log priors), from rows that are not held out."""
    return train_with_spread(docs, id_col, text_col, lang_col, bound)[0]


def train_with_spread(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", bound=TRAIN_DOCS):
    """(the model of train(), (mean, deviation) of the log-probabilities of each language's training n-grams)."""
    taught = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    taught = taught.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    taught = bounded_sample(taught, bound, "i")
    names = sorted(r.l for r in taught.select("l").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages among the labelled documents: clean the column or raise MAX_LANGUAGES")

    def count(batches):
        sums: dict[str, np.ndarray] = {}

        def emitted():
            for lang, own in sums.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at])], ["l", "f", "n"])
            sums.clear()

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for at, texts in row_blocks(batch.column(0)):
                ids, sizes, _ = features(texts, ORDERS, BUCKETS)
                ends = np.cumsum(sizes)
                for k, lang in enumerate(langs[at : at + len(texts)]):
                    own = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    own[:BUCKETS] += np.bincount(ids[ends[k] - sizes[k] : ends[k]], minlength=BUCKETS)
                    own[BUCKETS] += 1
                    if len(sums) > HELD_LANGUAGES:
                        yield from list(emitted())
        yield from emitted()

    sums = taught.select("t", "l").mapInArrow(trimmed(count), "l string, f long, n long").groupBy("l", "f").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    lang, f, n = found.column("l").to_pylist(), np.asarray(found.column("f")), np.asarray(found.column("n"))
    if not names:
        return ([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0)), (np.zeros(0), np.zeros(0))
    counts, at = np.zeros((BUCKETS + 1, len(names))), {x: k for k, x in enumerate(names)}
    counts[f, np.array([at[x] for x in lang])] = n
    docs_of, own = counts[BUCKETS], counts[:BUCKETS]
    smooth = own + SMOOTHING
    matrix = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
    share = own / np.maximum(own.sum(axis=0), 1)
    mean = (share * matrix).sum(axis=0)
    spread = np.sqrt((share * (matrix - mean) ** 2).sum(axis=0))
    return (names, matrix, np.log(docs_of / docs_of.sum())), (mean, spread)


def _scorer(shared, orders=ORDERS, buckets=BUCKETS, spread=None):
    """A function from a column of texts to (languages, scores), for workers; with ``spread``, unlikely texts are UNKNOWN."""

    def scored(column: pa.Array) -> tuple[list[str], list[float]]:
        names, matrix, prior = shared.value
        langs, scores = [], []
        for _, texts in row_blocks(column):
            ids, sizes, lettered = features(texts, orders, buckets)
            if not names:
                langs += [UNKNOWN] * len(texts)
                scores += [0.0] * len(texts)
                continue
            total = np.tile(prior, (len(texts), 1))
            some = np.flatnonzero(sizes)
            if len(some):
                starts = (np.cumsum(sizes) - sizes)[some]
                for k in range(len(names)):
                    total[some, k] += np.add.reduceat(matrix[:, k][ids], starts, dtype=np.float64)
            best = total.argmax(axis=1)
            odds = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            if spread is not None and len(some):
                mean, deviation = (x[best[some]] for x in spread)
                per_gram = (total[some, best[some]] - prior[best[some]]) / sizes[some]
                lettered[some] &= per_gram >= mean - deviation * (FLOOR_SPREADS + FLOOR_ERRORS / np.sqrt(sizes[some]))
            langs += [names[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
            scores += np.where(lettered, odds, 0.0).tolist()
        return langs, scores

    return scored


def predict(docs: DataFrame, model, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, lang_pred, score) of every row; score is the posterior probability of the predicted language."""
    scored = _scorer(docs.sparkSession.sparkContext.broadcast(model))

    def run(batches):
        for batch in batches:
            langs, scores = scored(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(trimmed(run), "id long, lang_pred string, score double")


def recognised(docs: DataFrame, model, least: float, spread, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` whose language is predicted with a score of ``least`` or more and that are likely in it, all columns as they are.

    ``model`` and ``spread`` come from train_with_spread().
    """
    schema, at = docs.schema, docs.columns.index(text_col)
    scored = _scorer(docs.sparkSession.sparkContext.broadcast(model), spread=spread)

    def run(batches):
        for batch in batches:
            langs, scores = scored(batch.column(at).cast(pa.string()))
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(trimmed(run), schema)


def identify(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """Learn from the labelled rows of ``docs`` that are not held out, then predict every row."""
    return predict(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
