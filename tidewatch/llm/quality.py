"""Quality classifier: evidence of a document's own text, joined with host and path rates that are shrunk toward the global one."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import bytes_of, cut, spread_lookup

SAMPLE = 20_000            # labelled rows that the text model is fitted on, chosen by hash of their id
WORDS_PER_TARGET = 500     # words that a target keeps, by likelihood ratio
TARGETS = ("junk", "toxic")
_SPLIT = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in bytes(range(256)).lower())
_UPPER = bytes(range(65, 91))
_LETTERS = bytes(b for b in range(256) if not 65 <= b <= 90)


def text_features(raw: bytes) -> tuple[set[bytes], list[bytes]]:
    """Distinct words of a whole text, and its shape: shares of capitals, signs, bars and new words, in coarse steps."""
    words = raw.translate(_SPLIT).split()
    distinct = set(words)
    n, size = len(words), max(1, len(raw))

    def step(name: str, share: float) -> bytes:
        return f"={name}:{0 if share <= 0 else max(-8, round(2 * math.log2(share))) + 9}".encode()

    signs = sum(raw.count(c) for c in (b"#", b"$", b"%", b"&", b"*", b"!", b"|", b"<", b">", b"@", b"^", b"~", b"=", b"_"))
    lines = raw.split(b"\n")
    shape = [step("upper", len(raw.translate(None, _LETTERS)) / size), f"=signs:{min(4, 4 * signs // max(1, n))}".encode(),
             f"=bars:{min(4, 4 * raw.count(b'|') // max(1, n))}".encode(), step("lines", len(set(lines)) / len(lines)),
             f"=new:{round(20 * math.log(len(distinct) + 1) / math.log(n + 1)) if n > 9 else -1}".encode(), f"=length:{round(math.log2(n + 1)) if n < 16 else 4}".encode()]
    return distinct, shape


class TextModel:
    """Log-odds of each target from a bounded set of words and shapes."""

    def __init__(self, bias: list[float], weights: dict[bytes, tuple[float, ...]]):
        self.bias, self.weights = bias, weights

    def log_odds(self, raw: bytes) -> list[float]:
        distinct, shape = text_features(raw)
        out = list(self.bias)
        for f in [*sorted(self.weights.keys() & distinct), *shape]:
            for k, w in enumerate(self.weights.get(f, ())):
                out[k] += w
        return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first column is the constant and is not shrunk."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        slope, curve = -penalty * w, np.diag(penalty)
        for lo in range(0, len(y), 2000):                # in blocks, as only the bytes of ``x`` are held as a whole
            part = x[lo:lo + 2000].astype(np.float32)
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            slope = slope + part.T @ (y[lo:lo + 2000] - p)
            curve = curve + (part * (p * (1 - p)).astype(np.float32)[:, None]).T @ part
        move = np.linalg.solve(curve, slope)
        w += np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-3:
            break
    return w


def fit_text_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, top: int = WORDS_PER_TARGET) -> TextModel:
    """Fits the model of a document's own text on at most ``sample`` labelled rows (label columns ``quality`` and ``toxic``, 0 or 1).

    Words are counted by class over the sample in Spark; the driver gets the chosen words and, per sampled row, which of them it has.
    Labels that are null or contradict each other are left out.  Without labels every text has even odds to be clean."""
    marks = (labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("q"), F.max("quality").alias("q2"), F.min("toxic").alias("t"), F.max("toxic").alias("t2"))
             .where("q = q2 AND t = t2").select("id", (1 - F.col("q")).alias("junk"), F.col("t").alias("toxic")))
    chosen = F.broadcast(marks.orderBy(F.xxhash64("id"), "id").limit(sample))

    def scan(batches):
        for batch in batches:
            found = [text_features(t) for t in bytes_of(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["junk"], batch["toxic"], pa.array([sorted(w) + s for w, s in found], pa.list_(pa.binary()))], ["junk", "toxic", "has"])
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("text", F.col("junk").cast("int"), F.col("toxic").cast("int"))
               .mapInArrow(scan, "junk INT, toxic INT, has ARRAY<BINARY>"), "labelled")
    n, *positive = rows.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(t), F.lit(0)) for t in TARGETS]).first()
    if not n:
        return TextModel([-1.0] * len(TARGETS), {})
    by_word = rows.select(*TARGETS, F.explode("has").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(t) for t in TARGETS])
    columns: list[bytes] = []
    for t, p in zip(TARGETS, positive, strict=True):
        # likelihood ratio of "the word tells the target", for words that speak for it and are seen in several such texts
        a, b = F.col(t) + 0.5, F.col("n") - F.col(t) + 0.5
        odds = F.log(a / b) - F.lit(math.log((p + 0.5) / (n - p + 0.5)))
        words = by_word.where((F.col(t) >= 2) & (odds > 1.5) & (F.substring("f", 1, 1) != F.lit(b"="))).orderBy((F.col(t) * odds).desc(), "f").limit(top)
        columns += [bytes(r.f) for r in words.select("f").collect()]
    columns += [bytes(r.f) for r in by_word.where((F.substring("f", 1, 1) == F.lit(b"=")) & (F.col("n") >= 3)).select("f").collect()]
    columns = sorted(set(columns))
    place = {f: i for i, f in enumerate(columns)}

    def pick(batches):
        for batch in batches:
            has = [[place[f] for f in fs if f in place] for fs in batch["has"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["junk"], batch["toxic"], pa.array(has, pa.list_(pa.int32()))], ["junk", "toxic", "has"])
    data = rows.mapInArrow(pick, "junk INT, toxic INT, has ARRAY<INT>").toArrow()
    keys = list(zip(*(data[c].to_pylist() for c in ("junk", "toxic", "has")), strict=True))
    data = data.take(sorted(range(len(keys)), key=keys.__getitem__))      # sums of floats in one order; at most ``sample`` rows
    has = data["has"].combine_chunks()
    x = np.zeros((len(data), len(columns) + 1), np.uint8)
    x[:, 0] = 1
    x[np.repeat(np.arange(len(data)), np.diff(has.offsets.to_numpy())), has.flatten().to_numpy() + 1] = 1
    fitted = [_logistic(x, data[t].to_numpy().astype(np.float64)) for t in TARGETS]
    return TextModel([float(w[0]) for w in fitted], {f: tuple(float(w[i + 1]) for w in fitted) for f, i in place.items()})


def _strength(mean: Column, n: str, s: str) -> Column:
    """How many rows the prior is worth, by the method of moments: small when rates differ between groups more than chance lets them."""
    weight = F.sum(n)
    spread = F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - mean, 2)) / weight - F.count(F.lit(1)) * F.avg(mean * (1 - mean)) / weight
    return F.least(F.greatest(F.avg(mean * (1 - mean)) / F.greatest(spread, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1e6))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """Adds ``host_rate, path_rate, posterior`` to rows ``doc_id, host, path, evidence`` (log-odds that the row is bad).

    Three levels: a global rate; host rates with a beta prior around it; path rates with a beta prior around their host's.  Strengths of
    both priors come from the data.  A row's own evidence is taken out of its host and path before its odds are moved by theirs, so a
    site with a single row says nothing about it; ``host_rate`` and ``path_rate`` are those rates, of the other rows.  Null hosts and paths are groups of their own."""
    rows = scored.withColumns({"host": F.coalesce(F.col("host").cast("string"), F.lit("")), "path": F.coalesce(F.col("path").cast("string"), F.lit("")),
                               "p": 1 / (1 + F.exp(-F.col("evidence")))})
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.count(F.lit(1)).alias("width"))
    all_n, all_s = hosts.agg(F.coalesce(F.sum("hn"), F.lit(0)), F.coalesce(F.sum("hs"), F.lit(0.0))).first()
    rate = F.lit((all_s + 0.5) / (all_n + 1))
    k = F.lit(hosts.agg(_strength(rate, "hn", "hs")).first()[0] or 1.0)
    hosts = hosts.withColumn("host_rate", (F.col("hs") + k * rate) / (F.col("hn") + k))
    paths = spread_lookup(paths, hosts.select("host", "host_rate", "hn", "hs", "width"), ["host"], "width", F.col("path")).drop("width")
    k2 = F.lit(paths.agg(_strength(F.col("host_rate"), "n", "s")).first()[0] or 1.0)
    met = spread_lookup(rows, paths, ["host", "path"], "n", F.col("doc_id"))
    host_others = (F.col("hs") - F.col("p") + k * rate) / (F.col("hn") - 1 + k)
    others = (F.col("s") - F.col("p") + k2 * host_others) / (F.col("n") - 1 + k2)
    safe = F.least(F.greatest(others, F.lit(1e-6)), F.lit(1 - 1e-6))
    moved = F.col("evidence") + _logit(safe) - _logit(rate)
    return met.select("doc_id", "host", "path", "evidence", host_others.alias("host_rate"), safe.alias("path_rate"), (1 / (1 + F.exp(-moved))).alias("posterior"))


def classify(docs: DataFrame, model: TextModel, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", reject: float = 0.5) -> DataFrame:
    """Per row of ``docs``: ``doc_id, junk_log_odds, toxic_log_odds, host_rate, path_rate, posterior, kept``.

    Evidence against a row is the larger of its two log-odds; a row whose posterior reaches ``reject`` is not kept.  Null text counts as
    empty, which is judged by its shape like any other; repeated rows are scored each; further columns are ignored; an empty table gives no rows."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.bias, model.weights))

    def scan(batches):
        m = TextModel(*shared.value)
        for batch in batches:
            odds = [m.log_odds(t) for t in bytes_of(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["host"], batch["path"], pa.array([o[0] for o in odds], pa.float64()), pa.array([o[1] for o in odds], pa.float64())],
                                             ["doc_id", "host", "path", "junk_log_odds", "toxic_log_odds"])
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    scored = cut(rows.mapInArrow(scan, "doc_id BIGINT, host STRING, path STRING, junk_log_odds DOUBLE, toxic_log_odds DOUBLE")
                 .withColumn("evidence", F.least(F.greatest("junk_log_odds", "toxic_log_odds", F.lit(-12.0)), F.lit(12.0))), "scored")
    out = site_posteriors(scored.withColumn("doc_id", F.struct("doc_id", "junk_log_odds", "toxic_log_odds")))
    return out.select("doc_id.doc_id", "doc_id.junk_log_odds", "doc_id.toxic_log_odds", "host_rate", "path_rate", "posterior", (F.col("posterior") < reject).alias("kept"))


def site_of(url: Column) -> tuple[Column, Column]:
    """Host and first path part of a URL column, for tables that have one."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*/([^/?#]*)", 1)


def good_documents(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", reject: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier fitted on ``labels`` keeps.

    An id is rejected if any of its rows is; rows without an id have no place in the result by which they could be rejected, and stay."""
    found = classify(docs, fit_text_model(docs, labels, id_col, text_col), host, path, id_col, text_col, reject)
    bad = found.where(~F.col("kept")).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(bad, id_col, "left_anti").select(*docs.columns)
