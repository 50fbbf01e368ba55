"""URL filter: host and path rules, and a ratio of two character language models for the URLs that no rule fits.

Two smoothed variable-order Markov models (accepted and rejected URLs, labelled by the rules themselves) give each
character a probability from its longest known context, interpolated downwards (Witten-Bell).  The verdict is the sign of
the length-normalised log-likelihood difference against a threshold that is calibrated on labelled URLs held out of the
counts.  Everything is DataFrame expressions: counts are partial aggregates, the score table has a row for each distinct
window of characters, and URLs meet it in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.storage import materialise

#: (host, path, verdict); a rule fits its host, all subdomains, and paths that start with its path.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Characters of context of the longest model.
ORDER = 4
#: Rows of the score table up to which it is broadcast (about 60 bytes a row); beyond it the join is shuffled and salted.
BROADCAST_ROWS = 200_000
SALTS = 32
_PAD = "\x02"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column; both empty without ``://``."""
    after = F.instr(url, "://")
    rest = F.when(after > 0, F.substr(url, after + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def with_rule(df: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (longest fitting rule as ``host/path``, else null) and ``ruled`` (its verdict)."""
    host, path = host_path(F.col(url))
    df = df.withColumn("host", host).withColumn("path", path)
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # a longer one is asked first: it wraps the shorter
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("ruled", verdict)


def _windows(df: DataFrame, order: int) -> DataFrame:
    """A row for each character of ``u`` and for its end, with all other columns of ``df``: ``gram`` is the character after
    ``order`` before it.  Linear in the characters: the windows are the padded characters zipped with themselves."""
    letters = F.concat(F.array_repeat(F.lit(_PAD), order), F.regexp_extract_all("u", F.lit("(?s)."), F.lit(0)), F.array(F.lit("\x03")))
    size, grams = F.size("p") - order, None
    for k in range(order + 1):
        part = F.slice("p", k + 1, size)
        grams = part if grams is None else F.zip_with(grams, part, lambda a, b: F.concat(a, b))
    return df.withColumn("p", letters).withColumn("gram", F.explode(grams)).drop("p", "u")


def _beside(table: DataFrame) -> DataFrame:
    """``table``, to be broadcast if its rows are few."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def train(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """Score table ``(gram, delta)`` from ``(u, ruled, n)``: delta is log P(char | context) accepted minus rejected.

    Each window of ``order + 1`` characters of any URL has a row; only URLs whose ``ruled`` is allow or block add to the
    counts, so a window that a class never had is scored from its longest known context.  Smoothing: P_k = (count + types * P_{k-1}) / (total + types), P_{-1} uniform over 256.
    """
    grams = _windows(urls, order).groupBy("gram").agg(
        *(F.sum(F.when(F.col("ruled") == c, F.col("n")).otherwise(0)).alias(c) for c in ("allow", "block"))
    )
    grams = materialise(grams, "grams")
    out, prob = grams.select("gram"), {"allow": F.lit(1 / 256), "block": F.lit(1 / 256)}
    for k in range(order + 1):
        window, context = F.expr(f"right(gram, {k + 1})").alias("sym"), F.expr(f"left(right(gram, {k + 1}), {k})").alias("ctx")
        seen = grams.groupBy(window, context).agg(*(F.sum(c).alias(f"{c}_n{k}") for c in prob))
        totals = seen.groupBy("ctx").agg(
            *(F.sum(f"{c}_n{k}").alias(f"{c}_t{k}") for c in prob), *(F.count_if(F.col(f"{c}_n{k}") > 0).alias(f"{c}_d{k}") for c in prob)
        )
        if k < 2:  # few keys that everything has
            seen, totals = _beside(seen), _beside(totals)
        out = out.withColumn("sym", window).withColumn("ctx", context).join(seen.drop("ctx"), "sym").join(totals, "ctx").drop("sym", "ctx")
        for c in prob:
            n, t, d = (F.col(f"{c}_{x}{k}") for x in "ntd")
            prob[c] = F.when(t > 0, (n + d * prob[c]) / (t + d)).otherwise(prob[c])
    return out.select("gram", (F.log(prob["allow"]) - F.log(prob["block"])).alias("delta"))


def score(urls: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """``(row, score)`` from ``(row, u)``: the mean delta of a URL's characters.

    The model is broadcast if it has at most BROADCAST_ROWS rows; otherwise both sides are shuffled by the window and a
    salt, with the model repeated for each salt.
    """
    grams = _windows(urls.select("row", "u"), order)
    if model.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = grams.join(F.broadcast(model), "gram", "left")
    else:
        salted = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = grams.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["gram", "salt"], "left")
    return joined.groupBy("row").agg((F.sum(F.coalesce("delta", F.lit(0.0))) / F.count(F.lit(1))).alias("score"))


def calibrate(scored: DataFrame) -> float:
    """The threshold with the largest sum of the two classes' hit rates, from ``(score, ruled, n)``; 0 without both.

    Scores are counted in bins of 0.01 (bounded by the range of a log ratio of smoothed probabilities), so one small
    table is summed over; a threshold lies halfway between two bins that have URLs; ties go to the one closest to zero.
    """
    bins = scored.groupBy(F.floor(F.col("score") * 100).alias("bin")).agg(
        F.sum(F.when(F.col("ruled") == "allow", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("ruled") == "block", F.col("n")).otherwise(0)).alias("b")
    )
    below = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("bin").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    middle = (F.col("bin") + F.coalesce(F.lag("bin").over(W.orderBy("bin")), F.col("bin"))) / 2
    cut = bins.select("bin", middle.alias("middle"), F.coalesce(F.sum("a").over(below), F.lit(0)).alias("al"), F.coalesce(F.sum("b").over(below), F.lit(0)).alias("bl"), F.sum("a").over(whole).alias("at"), F.sum("b").over(whole).alias("bt"))
    best = cut.where("at > 0 and bt > 0").orderBy((F.col("bl") / F.col("bt") - F.col("al") / F.col("at")).desc(), F.abs("middle"), "bin").first()
    return best.middle / 100 if best else 0.0


def judge(df: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """``key, url, host, path, rule, score, verdict`` for every row; only the named columns are read.

    Null URLs and URLs without ``://`` have empty host and path; a null URL is scored as an empty one.  Equal rows are
    judged once and all returned.  Where the rules leave a class without URLs, unruled ones are allowed.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("k"), F.col(url).alias("url")).repartition(spark.sparkContext.defaultParallelism, "k", "url")
    rows = with_rule(rows.groupBy("k", "url").agg(F.count(F.lit(1)).alias("copies")), rules)
    rows = materialise(rows.withColumn("u", F.coalesce("url", F.lit(""))).withColumn("row", F.monotonically_increasing_id()), "urls")
    held = (F.pmod(F.xxhash64("u"), F.lit(5)) == 0) & F.col("ruled").isNotNull()
    model = train(rows.select("u", F.when(~held, F.col("ruled")).alias("ruled"), F.col("copies").alias("n")), order)
    scored = materialise(score(rows, materialise(model, "model"), order), "scores")
    threshold = calibrate(rows.where(held).select("row", "ruled", F.col("copies").alias("n")).join(scored, "row"))
    both = rows.where("ruled is not null").agg(F.count_distinct("ruled").alias("c")).first().c == len({"allow", "block"})
    method = F.when(F.col("score") >= F.lit(threshold), "allow").otherwise("block") if both else F.lit("allow")
    done = rows.join(scored, "row").withColumn("verdict", F.coalesce("ruled", method))
    # every copy again, in blocks of bounded size
    done = done.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(4096).cast("long"))))
    done = done.withColumn("again", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(4096), F.col("copies") - F.col("at")).cast("int"))))
    return done.select(F.col("k").alias(key), F.col("url").alias(url), "host", "path", "rule", "score", "verdict")
