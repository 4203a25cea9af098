"""URL filter by rules and a character language-model ratio [native].

Two smoothed variable-order Markov models (orders 2, 1, 0, Witten-Bell
interpolation: the more a context has been seen, the more its own counts weigh)
are counted over all URLs that a rule allows and over all that a rule blocks. A
URL without a rule is judged by the difference of its log-likelihoods per
character, against a threshold calibrated on rule-labelled URLs that the counts
leave out.

Everything is DataFrame expressions. The models are one dense array of
``SYMBOLS ** 3`` numbers (0.94 MB, whatever the input), read by a scalar
subquery; counts are combined before their shuffle into at most that many rows
per class; scoring is a narrow projection without a shuffle. Log-ratios are kept
as whole micro-nats, so sums do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Known characters have the codes 1 to 47; 48 is any other, 0 stands before the start.
ALPHABET = LOWER + "0123456789./-_?=&#%:~"
SYMBOLS = len(ALPHABET) + 2
TABLE = SYMBOLS**3
#: Scores are floored to bins of so many micro-nats a character; bins beyond the ends count as the ends.
BIN, END = 10_000, 1000


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct of rule and verdict of the longest rule that fits, else null."""
    found = None
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def codes_of(url: Column) -> Column:
    """Codes of the characters of a lower-cased URL; none for an empty one."""
    known = lambda c: F.position(c, F.lit(ALPHABET))
    return F.when(url == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(url, ""), lambda c: F.when(known(c) == 0, SYMBOLS - 1).otherwise(known(c))))


def _grams(labelled: DataFrame) -> DataFrame:
    """Counts of three following codes (two before, one now) by class."""
    # the codes moved by two and by one place, so that each step is one pass over the array
    two, one = F.concat(F.array(F.lit(0), F.lit(0)), "codes"), F.concat(F.array(F.lit(0)), "codes")
    step = lambda a, b: (a * SYMBOLS + b).cast("int")
    moved = F.zip_with(F.zip_with(two, one, step), F.col("codes"), step)
    return labelled.select("allowed", F.explode(moved).alias("gram")).filter("gram IS NOT NULL").groupBy("allowed", "gram").agg(F.count("*").alias("n"))


def _model(grams: DataFrame, spark) -> DataFrame:
    """One row: the array of log-ratios in micro-nats, by gram."""
    parts = grams.select("allowed", "n", (F.col("gram") % SYMBOLS).alias("c"), (F.col("gram") / SYMBOLS).cast("int").alias("ab"))
    parts = parts.withColumn("b", F.col("ab") % SYMBOLS)
    n_c = parts.groupBy("allowed", "c").agg(F.sum("n").alias("n_c"))
    n_all = parts.groupBy("allowed").agg(F.sum("n").alias("n_all"))
    n_bc = parts.groupBy("allowed", "b", "c").agg(F.sum("n").alias("n_bc"))
    n_b = n_bc.groupBy("allowed", "b").agg(F.sum("n_bc").alias("n_b"), F.count("*").alias("t_b"))
    n_ab = parts.groupBy("allowed", "ab").agg(F.sum("n").alias("n_ab"), F.count("*").alias("t_ab"))
    grid = spark.range(TABLE).select(F.col("id").cast("int").alias("gram"), F.explode(F.array(F.lit(True), F.lit(False))).alias("allowed"))
    grid = grid.withColumn("c", F.col("gram") % SYMBOLS).withColumn("ab", (F.col("gram") / SYMBOLS).cast("int")).withColumn("b", F.col("ab") % SYMBOLS)
    for table, on in ((grams, ["allowed", "gram"]), (n_ab, ["allowed", "ab"]), (n_bc, ["allowed", "b", "c"]), (n_b, ["allowed", "b"]), (n_c, ["allowed", "c"]), (n_all, ["allowed"])):
        grid = grid.join(table, on, "left")  # each side has at most TABLE rows
    z = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("double")
    p1 = (z("n_c") + 1) / (z("n_all") + SYMBOLS)
    p2 = F.when(z("n_b") == 0, p1).otherwise((z("n_bc") + z("t_b") * p1) / (z("n_b") + z("t_b")))
    p3 = F.when(z("n_ab") == 0, p2).otherwise((z("n") + z("t_ab") * p2) / (z("n_ab") + z("t_ab")))
    ratio = F.round(F.sum(F.when(F.col("allowed"), F.ln("p")).otherwise(-F.ln("p"))) * 1e6).cast("bigint")
    rows = grid.withColumn("p", p3).groupBy("gram").agg(ratio.alias("ratio"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("gram", "ratio"))), lambda x: x.ratio).alias("ratios"))


def bin_of(model: DataFrame, df: DataFrame) -> DataFrame:
    """``df`` with ``bin``: floor of the mean log-ratio a character in hundredths of a nat."""
    total = F.aggregate(
        "codes",
        F.struct(F.lit(0).cast("int").alias("h"), F.lit(0).cast("bigint").alias("s")),
        lambda acc, c: F.struct(((acc.h * SYMBOLS + c) % TABLE).cast("int").alias("h"), (acc.s + F.col("ratios")[((acc.h * SYMBOLS + c) % TABLE).cast("int")]).alias("s")),
        lambda acc: acc.s,
    )
    size = F.size("codes").cast("bigint") * BIN
    low = df.withColumn("ratios", model.scalar()).withColumn("total", total).drop("ratios")
    mean = (F.col("total") - F.pmod("total", F.greatest(size, F.lit(1)))) / F.greatest(size, F.lit(1))
    return low.withColumn("bin", F.greatest(F.lit(-END), F.least(F.lit(END), mean.cast("bigint")))).drop("total")


def _threshold(bins: DataFrame) -> DataFrame:
    """One row: the bin from which on URLs are allowed; the best mean of both classes' hit rates.

    All thresholds between two neighbouring bins that occur are alike; the one
    nearest to 0 stands for them. Ties: the nearest to 0, then the lower one; 0 if
    a class is missing.
    """
    counted = bins.groupBy("bin").agg(F.count_if("allowed").alias("a"), F.count_if(~F.col("allowed")).alias("r"))  # at most 2 * END + 1 rows
    steps = counted.withColumn("all_a", F.expr("sum(a) over ()")).withColumn("all_r", F.expr("sum(r) over ()"))
    steps = steps.withColumn("good", (F.col("all_a") - F.expr("sum(a) over (order by bin rows between unbounded preceding and current row)") + F.col("a")) * F.col("all_r") + (F.expr("sum(r) over (order by bin rows between unbounded preceding and current row)") - F.col("r")) * F.col("all_a"))
    steps = steps.withColumn("at", F.greatest(F.expr(f"coalesce(lag(bin) over (order by bin), {-END} - 1) + 1"), F.least(F.lit(0), "bin")))
    best = steps.filter("all_a > 0 AND all_r > 0").agg(F.max(F.struct("good", (-F.abs("at")).alias("near"), (-F.col("at")).alias("low"))).alias("best"))
    return best.select(F.coalesce(-F.col("best.low"), F.lit(0)).alias("least"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block).

    A rule's verdict wins; else the models'. Counts take the URLs with a rule but
    for 3 in 16 of them (by the first digit of the URL's MD5), which calibrate.

    * null url or one without ``://``: host and path empty; an empty URL scores 0.
    * no URL with a rule, or of one class only: threshold 0 and whatever the
      models say (all URLs score 0, and are allowed, if there is no URL at all).
    * repeated rows and URLs: each row gets its verdict, each counts.
    * empty table: empty result. Extra columns are ignored.
    """
    url = F.coalesce("url", F.lit(""))
    base = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), ascii_lower(url).alias("low"))
    base = base.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).withColumn("codes", codes_of(F.col("low")))
    labelled = base.filter("found IS NOT NULL").select((F.col("found.verdict") == "allow").alias("allowed"), "codes", F.substring(F.md5(F.col("low").cast("binary")), 1, 1).isin("0", "1", "2").alias("held"))
    with common.only(pages.sparkSession) as keep:
        model = common.materialise(_model(common.materialise(_grams(labelled.filter("NOT held")), "url-grams"), pages.sparkSession), "url-model")
        keep.append(model)
    least = common.materialise(_threshold(bin_of(model, labelled.filter("held"))), "url-threshold")
    said = F.when(F.col("bin") >= least.scalar(), "allow").otherwise("block")
    return bin_of(model, base).select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), said).alias("verdict"))


def _oracle() -> str:
    rules = " ".join(
        f"WHEN (host = '{r[: (i := r.index('/'))]}' OR ends_with(host, '.{r[:i]}')) AND starts_with(path, '{r[i:]}') THEN '{r}'" for r, _ in sorted(RULES, key=lambda r: -len(r[0]))
    )
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES)
    n, last = SYMBOLS, SYMBOLS - 1
    return f"""
WITH base AS (
  SELECT row_number() OVER () AS row_no, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low FROM pages
), ruled AS (SELECT *, CASE {rules} END AS rule FROM base
), judged AS (SELECT *, CASE rule {verdicts} END AS fixed, substr(md5(low), 1, 1) IN ('0', '1', '2') AS held FROM ruled
), letters AS (
  SELECT row_no, i, CASE WHEN strpos('{ALPHABET}', substr(low, i, 1)) = 0 THEN {last} ELSE strpos('{ALPHABET}', substr(low, i, 1)) END AS c
  FROM (SELECT row_no, low, unnest(generate_series(1, length(low))) AS i FROM judged)
), grams AS (
  SELECT row_no, c, coalesce(lag(c) OVER w, 0) AS b, coalesce(lag(c, 2) OVER w, 0) AS a FROM letters WINDOW w AS (PARTITION BY row_no ORDER BY i)
), counted AS (
  SELECT fixed = 'allow' AS allowed, a, b, c, count(*) AS n FROM grams JOIN judged USING (row_no) WHERE fixed IS NOT NULL AND NOT held GROUP BY ALL
), k AS (SELECT unnest([true, false]) AS allowed
), need AS (SELECT DISTINCT a, b, c, k.allowed FROM grams, k
), n1 AS (SELECT allowed, c, sum(n) AS n_c FROM counted GROUP BY ALL
), n0 AS (SELECT allowed, sum(n) AS n_all FROM counted GROUP BY ALL
), n2 AS (SELECT allowed, b, c, sum(n) AS n_bc FROM counted GROUP BY ALL
), nb AS (SELECT allowed, b, sum(n_bc) AS n_b, count(*) AS t_b FROM n2 GROUP BY ALL
), nab AS (SELECT allowed, a, b, sum(n) AS n_ab, count(*) AS t_ab FROM counted GROUP BY ALL
), p1 AS (
  SELECT need.*, coalesce(n, 0)::DOUBLE n, coalesce(n_ab, 0)::DOUBLE n_ab, coalesce(t_ab, 0)::DOUBLE t_ab, coalesce(n_bc, 0)::DOUBLE n_bc, coalesce(n_b, 0)::DOUBLE n_b, coalesce(t_b, 0)::DOUBLE t_b,
         (coalesce(n_c, 0)::DOUBLE + 1) / (coalesce(n_all, 0)::DOUBLE + {n}) AS p1
  FROM need LEFT JOIN counted USING (allowed, a, b, c) LEFT JOIN nab USING (allowed, a, b) LEFT JOIN n2 USING (allowed, b, c) LEFT JOIN nb USING (allowed, b) LEFT JOIN n1 USING (allowed, c) LEFT JOIN n0 USING (allowed)
), p2 AS (SELECT *, CASE WHEN n_b = 0 THEN p1 ELSE (n_bc + t_b * p1) / (n_b + t_b) END AS p2 FROM p1
), p3 AS (SELECT *, CASE WHEN n_ab = 0 THEN p2 ELSE (n + t_ab * p2) / (n_ab + t_ab) END AS p3 FROM p2
), ratio AS (SELECT a, b, c, round(sum(CASE WHEN allowed THEN ln(p3) ELSE -ln(p3) END) * 1e6)::BIGINT AS ratio FROM p3 GROUP BY ALL
), mean AS (SELECT row_no, greatest(-{END}, least({END}, floor(sum(ratio)::DOUBLE / (count(*) * {BIN}))))::BIGINT AS bin FROM grams JOIN ratio USING (a, b, c) GROUP BY row_no
), binned AS (SELECT judged.*, coalesce(bin, 0) AS bin FROM judged LEFT JOIN mean USING (row_no)
), seen AS (SELECT bin, count(*) FILTER (fixed = 'allow') AS a, count(*) FILTER (fixed = 'block') AS r FROM binned WHERE fixed IS NOT NULL AND held GROUP BY bin
), good AS (SELECT t.bin, greatest((SELECT coalesce(max(p.bin) + 1, -{END}) FROM seen p WHERE p.bin < t.bin), least(0, t.bin)) AS at_, sum(CASE WHEN s.bin >= t.bin THEN s.a ELSE 0 END) * sum(s.r) + sum(CASE WHEN s.bin < t.bin THEN s.r ELSE 0 END) * sum(s.a) AS good, sum(s.a) AS all_a, sum(s.r) AS all_r FROM seen t, seen s GROUP BY t.bin
), best AS (SELECT coalesce((SELECT at_ FROM good WHERE all_a > 0 AND all_r > 0 ORDER BY good DESC, abs(at_), at_ LIMIT 1), 0) AS least)
SELECT page_id, host, path, rule, coalesce(fixed, CASE WHEN bin >= (SELECT least FROM best) THEN 'allow' ELSE 'block' END) AS verdict FROM binned
"""


ORACLE_SQL = _oracle()
