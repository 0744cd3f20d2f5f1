"""Quality classifier: a factorisation machine.

The features of a text are its hashed words, statistics of its structure and
metadata of its own (its length and its number of lines); labels, language,
source and ids are never read for a score. A text's score is

    sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

where the pairwise part is computed in time linear in the features by
``1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``.

Training uses at most ``SAMPLE`` labelled rows, those with the smallest hashes
of their ids; rows whose CRC-32 of the id as text is divisible by five are held
out. Only the sample's features come to the driver, of a text the statistics and its
``WIDTH`` strongest words (33 KB a row at most), and one model of 2.4 MB goes to the
executors; scoring reads every text whole and all its words.

Edge cases: null and empty texts are texts without words and get a score as any
other; of repeated labels of an id the smallest counts, of repeated rows with
that id one is learnt from, and each is scored; rows without or with a null
label are not learnt from; without any labelled rows every score is 0.5; null
ids are not held out; an empty table gives no rows; extra columns pass through
``keep_good`` and are ignored by ``score``.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilesieve.llm.common import keyed_text, map_rows

BUCKETS = 1 << 16
FACTORS = 8
SAMPLE = 4000
WIDTH = 4096  # features of a training row
THRESHOLD = 0.3
STATS = 17  # the first features; hashed words come after them

_word_table = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


_ascii, _ascii_capitals = bytes(range(128)), bytes(range(65, 91))


def upper_case(text: str, data: bytes) -> int:
    """How many characters of the whole text are upper-case; ``data`` is the text in UTF-8."""
    n = len(data) - len(data.translate(None, _ascii_capitals))
    # what is left without ASCII is whole characters, few in most texts
    return n if text.isascii() else n + sum(map(str.isupper, data.translate(None, _ascii).decode()))


def structure(text: str, data: bytes, tokens: list[bytes], counts: Counter) -> list[float]:
    """Statistics of a text; shares are 0 for texts without words."""
    n = max(1, len(tokens))
    size = max(1, len(data))
    lines = [x for x in data.split(b"\n") if x.strip()]

    def share(characters: bytes) -> float:
        return (len(data) - len(data.translate(None, characters))) / n

    upper = upper_case(text, data) / max(1, len(text))
    return [
        min(3.0, share(b"#*$%&<>@^~")),
        min(3.0, share(b"|")),
        min(3.0, share(b"!")),
        min(3.0, share(b".,;:?")),
        min(3.0, share(b"0123456789")),
        min(3.0, share(b"()[]{}\"'=/\\_")),
        3 * upper,
        1 - len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(bytes.__eq__, tokens, tokens[1:])) / n,
        math.log1p(len(tokens)) / 8,
        math.log1p(len(text)) / 10,
        math.log1p(len(lines)) / 5,
        1 - len(set(lines)) / max(1, len(lines)),
        min(3.0, size / n / 8),
        1.0 if len(tokens) < 20 else 0.0,
        1.0 if not tokens else 0.0,
    ]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values; word values have unit length together."""
    data = text.encode()
    tokens = data.split()
    counts = Counter(tokens)
    stats = structure(text, data, tokens, counts)
    words = Counter(data.translate(_word_table).split())
    at: dict[int, float] = {}
    for w, n in words.items():
        k = STATS + zlib.crc32(w) % (BUCKETS - STATS)
        at[k] = at.get(k, 0.0) + 1 + math.log(n)
    index = np.fromiter(at.keys(), np.int32, len(at))
    value = np.fromiter(at.values(), np.float32, len(at))
    if len(value):
        value /= np.sqrt(value @ value)
    return np.concatenate([np.arange(STATS, dtype=np.int32), index]), np.concatenate([np.array(stats, np.float32), value])


def strongest(index: np.ndarray, value: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The statistics and the words of the largest values, ``width`` features at most."""
    if len(index) <= width:
        return index, value
    keep = np.sort(np.concatenate([np.arange(STATS), STATS + np.argsort(-value[STATS:], kind="stable")[: width - STATS]]))
    return index[keep], value[keep]


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    @staticmethod
    def empty() -> Model:
        return Model(0.0, np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32))

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.factors[index] * value[:, None]
        total = v.sum(axis=0)
        z = self.bias + float(self.linear[index] @ value) + 0.5 * float(total @ total - (v * v).sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, visits: int = 40_000, rate: float = 0.1, decay: float = 1e-5, seed: int = 11) -> Model:
    """Logistic loss, AdaGrad, mini-batches; the same rows give the same model.

    Few rows are gone through more often, until about ``visits`` rows were seen.
    """
    if not rows:
        return Model.empty()
    random = np.random.default_rng(seed)
    share = float(np.clip(labels.mean(), 0.02, 0.98))
    bias, linear = math.log(share / (1 - share)), np.zeros(BUCKETS, np.float32)
    factors = (random.standard_normal((BUCKETS, FACTORS)) * 0.02).astype(np.float32)
    grown_linear, grown_factors = np.full(BUCKETS, 1e-2, np.float32), np.full((BUCKETS, FACTORS), 1e-2, np.float32)
    grown_bias = 1e-2
    for _ in range(min(150, max(8, visits // len(rows)))):
        order = random.permutation(len(rows))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            sizes = [len(rows[i][0]) for i in batch]
            index = np.concatenate([rows[i][0] for i in batch])
            value = np.concatenate([rows[i][1] for i in batch])
            owner = np.repeat(np.arange(len(batch)), sizes)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            v = factors[index] * value[:, None]
            total = np.add.reduceat(v, starts, axis=0)
            z = bias + np.add.reduceat(linear[index] * value, starts) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((v * v).sum(axis=1), starts))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]).astype(np.float32) / len(batch)
            each = error[owner] * value
            used, place = np.unique(index, return_inverse=True)
            slope = np.bincount(place, each, len(used)).astype(np.float32) + decay * linear[used]
            wide = each[:, None] * (total[owner] - v)
            by_factor = np.stack([np.bincount(place, wide[:, f], len(used)) for f in range(FACTORS)], axis=1).astype(np.float32) + decay * factors[used]
            grown_linear[used] += slope**2
            linear[used] -= rate * slope / np.sqrt(grown_linear[used])
            grown_factors[used] += by_factor**2
            factors[used] -= rate * by_factor / np.sqrt(grown_factors[used])
            grown_bias += float(error.sum()) ** 2
            bias -= rate * float(error.sum()) / math.sqrt(grown_bias)
    return Model(bias, linear, factors)


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled rows that are not held out."""
    known = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null").where(~held_out("id"))
    some = known.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = keyed_text(docs, id_col, text_col).join(F.broadcast(some), "id").groupBy("id", "label").agg(F.min("text").alias("text"))

    def start():
        def step(ids, given, texts):
            found = [strongest(*features(t)) for t in texts]
            return [ids, given, [f[0] for f in found], [f[1] for f in found]]

        return step

    found = map_rows(texts, "id bigint, label int, index array<int>, value array<float>", start).orderBy("id").toArrow()
    rows = [(np.asarray(i.values, np.int32), np.asarray(v.values, np.float32)) for i, v in zip(found["index"], found["value"])]
    return train(rows, np.array(found["label"].to_pylist(), np.float32))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        own = shared.value

        def step(ids, texts):
            return [ids, [own.score(*features(t)) for t in texts]]

        return step

    found = map_rows(keyed_text(docs, id_col, text_col), "id bigint, score double", start)
    return found.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows with a score of the threshold or more, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        own = shared.value
        for batch in batches:
            good = [own.score(*features(t or "")) >= threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
