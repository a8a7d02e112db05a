"""Quality classifier by importance resampling.

Two hashed n-gram models are counted: one of the target (good documents among the labelled) and one of all raw text. An
n-gram bucket's log ratio is log((target + prior) / (expected + prior)), where expected is its raw count at the
target's size: a bucket with little evidence stays near 0. Ratios are centred on their target mean, so length alone is
no evidence. A document's log weight is the sum of its n-grams' ratios over the number of n-grams to the power 0.75,
over ``temperature``; with Gumbel noise drawn from a hash of the document, the k largest keys are a sample without
replacement by weight. k is a parameter; without it, it is the number of documents whose weight reaches the one that all
but ``miss`` of the good labelled documents outside the target reach. At a temperature of 0.2 good documents' weights
spread by about as much as the noise over a tenth of its range, and junk lies ten and more below: near the cut the noise
decides, far from it hardly ever.

Toxic documents are rejected by a second table of the same kind: how many toxic documents (all their labels but junk's)
hold an n-gram, against how many would if they were good. A document's toxicity is the sum of its STRONGEST highest
ratios above FLOOR, whatever its length; it is rejected beyond the toxicity that all but ``toxic_miss`` of the good documents outside the
target stay within. k is counted, and the k keys taken, among the documents not rejected.

For toxicity the first PREFIXES bytes of longer tokens are n-grams too, in a table of their own, so that the forms of a
word count together.

Tokens are runs of letters, digits and other characters from U+0080, and runs of other marks; case is kept. N-grams are
tokens and pairs of adjacent tokens; a pair of equal tokens is one n-gram whatever the token.

The raw counts, the weights and the threshold cover all documents; target and held-back documents are bounded samples of
labelled rows (``target_docs`` each). Defined cases: a null text, or one without tokens, has weight 0; a doc_id that
repeats in the labels is good if all its rows are; ties at the threshold go to smaller doc_ids, and equal rows share
their fate; without good labels nothing is selected against: all are kept; without toxic ones none is rejected; extra columns are ignored or passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import fresh, save, slices, texts_of
from spanmill.llm.wordhash import mix, range_hashes

SCHEMA = "doc_id long, n_grams long, log_weight double, gumbel_key double, selected boolean"
STRONGEST, FLOOR, PREFIXES = 5, 1.0, (7, 8)
_KIND = np.array([0 if c in (9, 10, 11, 12, 13, 32) else 1 if chr(c).isalnum() and c < 128 or c >= 128 else 2 for c in range(256)], np.int8)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes, where their tokens start and end, and the text of each token."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    kind = _KIND[data]
    change = np.flatnonzero(np.diff(np.concatenate([[0], kind])) != 0)
    starts = change[kind[change] != 0]
    ends = np.concatenate([change, [len(data)]])[np.searchsorted(change, starts, "right")]
    return data, starts, ends, np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, "right")


def ngrams(cut: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts' tokens and pairs of adjacent tokens, and the text of each."""
    data, starts, ends, owner = cut
    one = range_hashes(data, starts, ends)
    pair = np.where(one[1:] == one[:-1], np.uint64(7), mix(one[:-1] * np.uint64(3) + one[1:]))
    same = owner[1:] == owner[:-1]
    shift = np.uint64(64 - bits)
    return np.concatenate([one >> shift, pair[same] >> shift if len(pair) else pair]).astype(np.int64), np.concatenate([owner, owner[1:][same]])


def stems(cut: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets, from 2**bits on, of the first PREFIXES bytes of longer tokens, and the text of each."""
    data, starts, ends, owner = cut
    buckets, owners = [], []
    for k in PREFIXES:
        long = ends - starts > k
        buckets.append((range_hashes(data, starts[long], starts[long] + k) >> np.uint64(64 - bits)).astype(np.int64) + (1 << bits))
        owners.append(owner[long])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Ratios:
    """Centred log ratios of target to raw and log ratios of toxic to good by n-gram bucket, and what turns a document into a weight and a toxicity."""

    table: np.ndarray
    toxic: np.ndarray
    bits: int
    temperature: float
    held_back: list[int]

    def weights(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cut = tokens(texts)
        bucket, owner = ngrams(cut, self.bits)
        n = np.bincount(owner, minlength=len(texts))
        total = np.bincount(owner, self.table[bucket], minlength=len(texts))
        both = (np.concatenate(x) for x in zip((bucket, owner), stems(cut, self.bits)))
        return n, total / np.maximum(n, 1) ** 0.75 / self.temperature, self.toxicity(*both, len(texts))

    def toxicity(self, bucket: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """The sum of each document's strongest ratios above FLOOR, each n-gram once."""
        over = self.toxic[bucket] > FLOOR
        owner, bucket = distinct(bucket[over], owner[over], self.bits + 1)
        order = np.lexsort((-self.toxic[bucket], owner))
        owner, bucket = owner[order], bucket[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        top = rank < STRONGEST
        return np.bincount(owner[top], self.toxic[bucket[top]], minlength=n)


def distinct(bucket: np.ndarray, owner: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Owners and buckets, each pair once."""
    pairs = np.unique(owner.astype(np.int64) << bits | bucket)
    return pairs >> bits, pairs & ((1 << bits) - 1)


def good_ids(labels: DataFrame) -> DataFrame:
    """doc_ids that all their labels call good: quality 1 and not toxic."""
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good).alias("good")).where("good").select("doc_id")


def toxic_ids(labels: DataFrame) -> DataFrame:
    """doc_ids that a label calls toxic and none junk."""
    seen = F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"), F.max(F.coalesce(F.col("quality") == 0, F.lit(False))).alias("junk")
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*seen).where("toxic AND NOT junk").select("doc_id")


def fit(docs: DataFrame, labels: DataFrame, target_docs: int = 20_000, bits: int = 18, prior: float = 300.0, temperature: float = 0.2, toxic_prior: float = 1.0) -> Ratios | None:
    """The ratio tables; None without good labels. 2**bits and target_docs bound what reaches the driver."""

    def sample(ids: DataFrame, k: int) -> list[int]:
        lot = ids.withColumn("lot", F.xxhash64("doc_id"))
        return [r.doc_id for r in lot.where(F.pmod("lot", F.lit(2)) == k).orderBy("lot", "doc_id").limit(target_docs).collect()]

    halves = [sample(good_ids(labels), k) for k in (0, 1)]
    picked = sorted(halves, key=len)
    if not picked[1]:
        return None
    held_toxic = sample(toxic_ids(labels), halves.index(picked[1]))
    target, toxic = (docs.sparkSession.sparkContext.broadcast(frozenset(x)) for x in (picked[1], held_toxic))

    names = ["raw", "own", "clean", "bad"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, own, clean, bad = np.zeros((4, 2 << bits), np.int64)
        seen = np.zeros(2, np.int64)
        for batch in slices(batches, "text"):
            cut = tokens(texts_of(batch, "text"))
            bucket, owner = ngrams(cut, bits)
            forms, of = stems(cut, bits)
            ids = batch.column("doc_id").to_pylist()
            good, hurt = (np.array([i in x.value for i in ids], bool) for x in (target, toxic))
            seen += good.sum(), hurt.sum()
            for mark, held in ((good, clean), (hurt, bad)):
                some = np.concatenate([bucket[mark[owner]], forms[mark[of]]]), np.concatenate([owner[mark[owner]], of[mark[of]]])
                held += np.bincount(distinct(*some, bits + 1)[1], minlength=2 << bits)
            raw += np.bincount(bucket, minlength=2 << bits)
            own += np.bincount(bucket[good[owner]], minlength=2 << bits)
        at = np.flatnonzero(raw + clean + bad)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(x[at]) for x in (raw, own, clean, bad))], names=["bucket", *names])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *(pa.array([x]) for x in (0, 0, *seen.tolist()))], names=["bucket", *names])  # documents

    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "bucket int, " + ", ".join(f"{x} long" for x in names))
    rows = counts.groupBy("bucket").agg(*(F.sum(x).alias(x) for x in names)).toPandas()
    table = np.zeros((4, (2 << bits) + 1))  # bucket -1 is the last
    table[:, rows.bucket] = rows[names].to_numpy().T
    raw, own, clean, bad = table[:, :-1]
    against = np.log((bad + toxic_prior) / (clean * (table[3, -1] / max(1.0, table[2, -1])) + toxic_prior))
    raw, own = raw[: 1 << bits], own[: 1 << bits]
    expected = raw * (own.sum() / max(1.0, raw.sum()))
    table = np.log((own + prior) / (expected + prior))
    table -= (table * own).sum() / max(1.0, own.sum())
    return Ratios(table, against, bits, temperature, picked[0] or picked[1])


def gumbel(doc_id: Column, seed: int = 1) -> Column:
    """Gumbel noise from a hash of the doc_id."""
    part = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(part))


def weigh(docs: DataFrame, ratios: Ratios) -> DataFrame:
    """doc_id, n_grams, log_weight, toxicity and gumbel_key."""
    held = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, weight, toxicity = held.value.weights(texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(weight, pa.float64()), pa.array(toxicity, pa.float64())], names=["doc_id", "n_grams", "log_weight", "toxicity"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_grams long, log_weight double, toxicity double")
    return rows.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id")))


def kth_largest(rows: DataFrame, k: int, buckets: int = 4096) -> tuple[float, int | None]:
    """(key, doc_id) of the k-th row by gumbel_key downward, then null doc_ids, then doc_id upward: ever finer histograms, no sort."""
    found = []
    for column, sign in (("gumbel_key", -1), ("doc_id", 1)):
        unknown = rows.where(F.col(column).isNull()).count()
        if k <= unknown:
            return found[0], None
        k -= unknown
        value, rows = sign * F.col(column), rows.where(F.col(column).isNotNull())
        low, high = rows.agg(F.min(value), F.max(value)).first()
        while low < high:
            above = value - F.lit(low) if column == "gumbel_key" else (value.cast("decimal(20,0)") - F.lit(Decimal(low))).cast("double")
            at = F.least(F.lit(buckets - 1), F.floor(above / ((high - low) / buckets))).cast("int")
            seen = 0
            for b, n in sorted(rows.groupBy(at.alias("b")).count().collect()):  # a row per bucket
                if seen + n >= k:
                    break
                seen += n
            k -= seen
            rows = rows.where(at == b)
            before = low, high
            low, high = rows.agg(F.min(value), F.max(value)).first()
            if (low, high) == before:
                raise ValueError("keys too close to tell apart")
        found.append(sign * low)
    return found[0], found[1]


def _kept(key: Column, doc_id: Column, threshold: tuple[float, int | None]) -> Column:
    """At or before the threshold row."""
    least, last = threshold
    tie = doc_id.isNull() if last is None else doc_id.isNull() | (doc_id <= last)
    return (key > least) | ((key == least) & tie)


def _select(docs: DataFrame, labels: DataFrame, miss: float, toxic_miss: float, k: int | None, **fitting) -> tuple[Ratios, DataFrame, float, tuple[float, int | None] | None] | None:
    """The fitted ratios, all documents' weights, the greatest toxicity allowed, and the threshold row of the k largest keys (None: none is kept)."""
    ratios = fit(docs, labels, **fitting)
    if ratios is None:
        return None
    rows = save(weigh(docs, ratios), "quality-weights")
    back = docs.sparkSession.createDataFrame([(i,) for i in ratios.held_back], "doc_id long")  # target_docs rows at most
    cuts = rows.join(F.broadcast(back), "doc_id").agg(F.percentile("log_weight", miss), F.expr(f"percentile_disc({1 - toxic_miss}) WITHIN GROUP (ORDER BY toxicity)")).first()
    least, most = (-np.inf, np.inf) if cuts[0] is None else cuts
    allowed = rows.where(F.col("toxicity") <= most)
    sizes = allowed.agg(F.count(F.lit(1)), F.count_if(F.col("log_weight") >= least)).first()
    k = sizes[1] if k is None else min(k, sizes[0])
    return ratios, rows, most, kth_largest(allowed.select("gumbel_key", "doc_id"), k) if k > 0 else None


def resample(docs: DataFrame, labels: DataFrame, miss: float = 0.003, toxic_miss: float = 0.006, k: int | None = None, **fitting) -> DataFrame:
    """Per document: n_grams, log_weight, gumbel_key, and whether it is among the k largest keys of those not toxic."""
    fitted = _select(docs, labels, miss, toxic_miss, k, **fitting)
    if fitted is None:
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_grams"), F.lit(0.0).alias("log_weight"))
        return ids.select("doc_id", "n_grams", "log_weight", gumbel(F.col("doc_id")).alias("gumbel_key"), F.lit(True).alias("selected"))
    _, rows, most, threshold = fitted
    kept = (F.col("toxicity") <= most) & _kept(F.col("gumbel_key"), F.col("doc_id"), threshold) if threshold else F.lit(False)
    return rows.select("doc_id", "n_grams", "log_weight", "gumbel_key", kept.alias("selected"))


def keep_good(docs: DataFrame, labels: DataFrame, miss: float = 0.003, toxic_miss: float = 0.006, k: int | None = None, **fitting) -> DataFrame:
    """The selected documents, all columns kept: the weights are worked out again beside the text, so no text is shuffled."""
    fitted = _select(docs, labels, miss, toxic_miss, k, **fitting)
    if fitted is None:
        return docs
    ratios, _, most, threshold = fitted
    if threshold is None:
        return docs.limit(0)
    held = docs.sparkSession.sparkContext.broadcast(ratios)
    least, last = threshold
    noise = fresh(docs, "__noise")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, weight, toxicity = held.value.weights(texts_of(batch, "text"))
            key = weight + batch.column(noise).to_numpy(zero_copy_only=False)
            tie = np.array([i is None or last is not None and i <= last for i in batch.column("doc_id").to_pylist()], bool)
            yield batch.drop_columns([noise]).filter(pa.array((toxicity <= most) & ((key > least) | (key == least) & tie)))

    return docs.withColumn(noise, gumbel(F.col("doc_id").cast("long"))).mapInArrow(run, docs.schema)
