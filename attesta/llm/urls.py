"""URL verdicts: host and path rules first, a character language-model ratio for the rest.

Rules name a host and a path prefix; a rule fits its host and all subdomains, and
the longest rule wins. Urls that a rule decides train two variable-order Markov
models, one of accepted and one of rejected urls: a character is predicted from
the longest context of up to ORDER characters that was seen twice or more, and
every order is smoothed into the next shorter one by Witten-Bell weights. A url's
score is the difference of its two log-likelihoods divided by its length; the
verdict is block above a threshold calibrated on a held-out quarter.

Every distinct url that a rule decides counts once, in the fit or, a quarter of them
by a hash, in the calibration, so both do not depend on row order or repeats. Markov,
Ratio and fit are the method in memory, for lists; url_verdicts is the same over
tables. There the model grows with the table and is nowhere as a whole: Spark counts
the grams (a character and its context), and probabilities follow order by order as
joins of a gram with the gram one shorter. Rows are gathered in shards beside the
shard's distinct grams; each of these is joined with its log-ratio, and the answers
meet the shard's rows. The threshold is found among all cuts between held-out scores,
sorted by range; the driver gets a row a range.

Defined results: a null url, or one without ://, has empty host and path, no rule
and, as any url whose rest is empty, score 0 and verdict allow; with fewer than
two urls of either kind in the fit the method scores 0 and allows all that no rule
decides; equal urls get equal scores and verdicts; repeated rows, null ids and long
urls are kept; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import forget, read, slices, written
from .perplexity import shard_number

ORDER, ALPHABET = 5, 256
FIRST, LAST = "\x02", "\x03"
SHARD_BYTES, COUNTED = 1 << 21, 1 << 18
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and all after the ://, the host in lower case."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.concat(host, F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as a string, and its verdict; null where none fits. Rules are a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


class Markov:
    """Variable-order character model; text begins and ends with a mark."""

    def __init__(self, texts: list[str], order: int = ORDER, alphabet: int = ALPHABET):
        following: dict[str, Counter] = defaultdict(Counter)
        for t in texts:
            marked = FIRST + t + LAST
            for i in range(1, len(marked)):
                for n in range(min(order, i) + 1):
                    following[marked[i - n : i]][marked[i]] += 1
        self.order, self.base = order, 1.0 / alphabet
        self.table = {c: (sum(f.values()), dict(f)) for c, f in following.items() if c == "" or sum(f.values()) > 1}

    def probability(self, context: str, char: str) -> float:
        p = self.base
        for n in range(len(context) + 1):
            found = self.table.get(context[len(context) - n :])
            if found is None:
                break
            total, after = found
            p = (after.get(char, 0) + len(after) * p) / (total + len(after))
        return p


class Ratio:
    """Length-normalised log-likelihood difference of rejected and accepted urls."""

    def __init__(self, accepted: list[str], rejected: list[str], order: int = ORDER):
        self.order = order
        self.usable = len(accepted) > 1 and len(rejected) > 1
        self.models = (Markov(rejected, order), Markov(accepted, order)) if self.usable else ()
        self.known: dict[tuple[str, str], float] = {}

    def score(self, text: str) -> float:
        if not self.usable or not text:
            return 0.0
        marked, total, known = FIRST + text + LAST, 0.0, self.known
        if len(known) > 500_000:
            known.clear()
        for i in range(1, len(marked)):
            key = (marked[max(0, i - self.order) : i], marked[i])
            x = known.get(key)
            if x is None:
                a, b = (m.probability(*key) for m in self.models)
                x = known[key] = math.log(a) - math.log(b)
            total += x
        return total / (len(marked) - 1)


def fit(accepted: list[str], rejected: list[str]) -> tuple[Ratio, float]:
    """The ratio, and the threshold of least balanced error on the held-out quarter."""
    held = lambda t: zlib.crc32(t.encode()) % 4 == 0
    ratio = Ratio([t for t in accepted if not held(t)], [t for t in rejected if not held(t)])
    good = sorted(ratio.score(t) for t in accepted if held(t))
    bad = sorted(ratio.score(t) for t in rejected if held(t))
    if not good or not bad:
        return ratio, 0.0
    points = sorted({*good, *bad})
    between = ((a, (a + b) / 2, b) for a, b in zip(points, points[1:], strict=False))
    cuts = [points[0] - 1, *(c if c < b else a for a, c, b in between), points[-1] + 1, 0.0]
    wrong = lambda c: (len(good) - bisect.bisect_right(good, c)) / len(good) + bisect.bisect_right(bad, c) / len(bad)
    return ratio, min(cuts, key=lambda c: (wrong(c), abs(c)))


def by_rule(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, att_rest, rule, rule_verdict): what the rules say of every url; att_rest is all after the ://."""
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("att_url"))
    host, path, rest = split_url(F.col("att_url"))
    base = base.select("page_id", host.alias("host"), path.alias("path"), rest.alias("att_rest"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return base.withColumns({"rule": rule, "rule_verdict": verdict})


def grams(text: str) -> list[str]:
    """Each character of the marked text after the first mark, with the ORDER characters before it, or as many as there are."""
    marked = FIRST + text + LAST
    return [marked[max(0, i - ORDER) : i + 1] for i in range(1, len(marked))]


def _gather(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The rows with the number of their shard, and at the end of each shard its distinct grams."""
    part, turn, size, seen = TaskContext.get().partitionId(), 0, 0, set()
    shard = shard_number(part, turn, buckets)

    def rows(n: int, schema: pa.Schema, given: dict[str, pa.Array]) -> pa.RecordBatch:
        columns = {"shard": pa.array([shard] * n, pa.int64()), "gram": pa.nulls(n, pa.string())} | {f.name: pa.nulls(n, f.type) for f in schema}
        return pa.RecordBatch.from_pydict(columns | given)

    def close(schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        found = list(seen)
        seen.clear()
        for i in range(0, len(found), 1 << 16):
            some = pa.array(found[i : i + (1 << 16)], pa.string())
            yield rows(len(some), schema, {"gram": some})

    schema = pa.schema([])
    for batch in batches:
        schema = batch.schema
        for piece in slices(batch, "att_rest"):
            yield rows(piece.num_rows, schema, dict(zip(schema.names, piece.columns, strict=True)))
            for t in piece.column("att_rest").to_pylist():
                if t:
                    seen.update(grams(t))
            size += piece.nbytes
            if size >= SHARD_BYTES:
                yield from close(schema)
                turn, size = turn + 1, 0
                shard = shard_number(part, turn, buckets)
    yield from close(schema)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each gram occurs in rejected and in accepted urls; a gram may be given several times."""
    kinds = ("block", "allow")
    found = {k: Counter() for k in kinds}

    def close() -> Iterator[pa.RecordBatch]:
        for kind, count in found.items():
            of = pa.array(count.values(), pa.int64())
            none = pa.array([0] * len(of), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), *(of if k == kind else none for k in kinds)], ["gram", "bad", "good"])
            count.clear()

    for batch in batches:
        for kind, t in zip(batch.column("att_rule").to_pylist(), batch.column("att_rest").to_pylist(), strict=True):
            found[kind].update(grams(t))
            if len(found[kind]) > COUNTED:
                yield from close()
    yield from close()


def _levels(counts: DataFrame) -> DataFrame:
    """(n, gram, bad, good, and of its context the sum and the number of distinct next characters of either kind), for all grams of n characters that end one of the counted ones."""
    whole = counts.groupBy("gram").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    tails = whole.select(F.explode(F.sequence(F.lit(1), F.length("gram"))).alias("n"), "gram", "bad", "good")
    tails = tails.groupBy("n", F.right("gram", F.col("n")).alias("gram")).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    context = Window.partitionBy("n", F.col("gram").substr(F.lit(1), F.col("n") - 1))  # at most a row a character
    return tails.withColumns({f"{k}_{what}": F.sum(x).over(context) for k in ("bad", "good") for what, x in (("total", F.col(k)), ("after", (F.col(k) > 0).cast("bigint")))})


def ratios(counts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(gram, x): log-likelihood of a gram's last character after the others in rejected urls less that in accepted ones, and the tables behind it. counts: (gram, bad, good), grams of no count included."""
    levels = written(_levels(counts), "levels", light=True)
    tables, parts = [levels], []
    for n in range(1, ORDER + 2):
        each = levels.filter(F.col("n") == n)
        if n == 1:
            each = each.withColumns({"bad_low": F.lit(1.0 / ALPHABET), "good_low": F.lit(1.0 / ALPHABET)})
        else:
            low = tables[-1].select(F.col("gram").alias("tail"), F.col("bad_p").alias("bad_low"), F.col("good_p").alias("good_low"))
            each = each.withColumn("tail", F.right("gram", F.lit(n - 1))).join(low, "tail")
        p = lambda k: F.when(F.col(f"{k}_total") > 1, (F.col(k) + F.col(f"{k}_after") * F.col(f"{k}_low")) / (F.col(f"{k}_total") + F.col(f"{k}_after"))).otherwise(F.col(f"{k}_low"))
        tables.append(written(each.select("gram", p("bad").alias("bad_p"), p("good").alias("good_p")), "p", light=True))
        if n > 1:  # shorter grams stand for themselves at the beginning of a text only
            parts.append(tables[-1] if n == ORDER + 1 else tables[-1].filter(F.col("gram").startswith(FIRST)))
    x = parts[0]
    for part in parts[1:]:
        x = x.unionAll(part)
    return x.select("gram", (F.log("bad_p") - F.log("good_p")).alias("x")), tables


def _scorer(names: list[str]):
    """Scores of a shard's rows from the log-ratios of its grams."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        known = dict(zip(right.column("gram").to_pylist(), right.column("x").to_pylist(), strict=True))
        found = [sum(map(known.__getitem__, grams(t))) / (len(t) + 1) if t else 0.0 for t in left.column("att_rest").to_pylist()]
        return pa.table([*(left.column(c) for c in names[:-1]), pa.array(found, pa.float64())], names)

    return score


def threshold(urls: DataFrame) -> float:
    """The cut of least balanced error. urls: (att_rule, score), a row a distinct url."""
    is_ = lambda kind: F.sum((F.col("att_rule") == kind).cast("bigint"))
    points = urls.groupBy("score").agg(is_("allow").alias("good"), is_("block").alias("bad"))
    points = written(points.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "points")
    below = lambda k: F.sum(F.when(F.col("score") <= 0, F.col(k)).otherwise(0))
    ranges = points.groupBy("part").agg(F.min("score").alias("first"), F.sum("good").alias("good"), F.sum("bad").alias("bad"), below("good").alias("good_0"), below("bad").alias("bad_0"))
    ranges = sorted(ranges.collect(), key=lambda r: r["first"])  # a row a range
    all_good, all_bad, good_0, bad_0 = (sum(r[c] for r in ranges) for c in ("good", "bad", "good_0", "bad_0"))
    if not all_good or not all_bad:
        forget(points)
        return 0.0
    before, good, bad = [], 0, 0
    for r, then in zip(ranges, [*(r["first"] for r in ranges[1:]), None], strict=True):
        before.append((r["part"], good, bad, then))
        good, bad = good + r["good"], bad + r["bad"]
    before = points.sparkSession.createDataFrame(before, "part int, good_before bigint, bad_before bigint, then double")
    inside = Window.partitionBy("part").orderBy("score")
    up_to = lambda k: F.sum(k).over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"{k}_before")
    each = points.join(F.broadcast(before), "part").select("score", up_to("good").alias("good"), up_to("bad").alias("bad"), F.coalesce(F.lead("score").over(inside), F.col("then")).alias("then"))
    middle = (F.col("score") + F.col("then")) / 2
    cut = F.when(F.col("then").isNull(), F.col("score") + 1).when(middle < F.col("then"), middle).otherwise(F.col("score"))
    wrong = (F.lit(all_good) - F.col("good")) / F.lit(all_good) + F.col("bad") / F.lit(all_bad)
    best = each.select(wrong.alias("wrong"), F.abs(cut).alias("far"), cut.alias("cut")).agg(F.min(F.struct("wrong", "far", "cut"))).first()[0]
    forget(points)
    least = ranges[0]["first"] - 1
    return min(tuple(best), (1.0, abs(least), least), ((all_good - good_0) / all_good + bad_0 / all_bad, 0.0, 0.0))[2]


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row."""
    base = by_rule(pages, id_col, url_col, rules).withColumnRenamed("rule_verdict", "att_rule")
    schema, buckets = StructType().add("shard", "long").add("gram", "string"), int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for f in base.schema.fields:
        schema = schema.add(f.name, f.dataType)
    gathered = written(base.mapInArrow(lambda batches: _gather(batches, buckets), schema), "gathered")
    rows, shards = gathered.filter("gram is null").select(F.col("shard").alias("of"), *base.columns), gathered.filter("gram is not null").select("shard", "gram")
    decided, held = F.col("att_rule").isNotNull() & (F.col("att_rest") != ""), F.crc32("att_rest") % 4 == 0
    counts = written(rows.filter(decided & ~held).select("att_rule", "att_rest").distinct().mapInArrow(_count, "gram string, bad bigint, good bigint"), "counts")
    fitted = counts.filter(F.length("gram") == 2).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()  # each url begins with one
    schema = StructType(schema.fields[2:]).add("score", "double")
    if min(fitted["bad"] or 0, fitted["good"] or 0) > 1:
        x, tables = ratios(counts.unionAll(shards.select("gram", F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))))
        answers = shards.join(x, "gram")
        scored = written(rows.groupBy("of").cogroup(answers.groupBy("shard")).applyInArrow(_scorer(schema.names), schema), "scored")
        forget(gathered, *tables)
        cut = threshold(scored.filter(decided & held).select("att_rule", "att_rest", "score").distinct())
    else:
        scored, cut = rows.withColumn("score", F.lit(0.0)), 0.0
    forget(counts)
    said = F.when((F.col("att_rest") != "") & (F.col("score") > cut), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("att_rule", said).alias("verdict"), "score")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """A verdict on every page's url."""
    return url_verdicts(read(spark, sf_dir, "pages"))
