"""URL filter: rules, and for the rest a logistic regression on hashed character n-grams.

Only DataFrame and SQL functions are used. Host and path are cut from the url by text functions; their
n-grams (``h:`` and ``p:`` in front, ``^`` and ``$`` around) are hashed into ``BUCKETS`` buckets. The
model is one weight a bucket. It is trained by gradient steps, each one aggregate over a small labelled
url table of at most ``MOST_LABELLED`` different rows (those with the smallest hash of the url, a documented
bound; each counts as often as it occurs); only the ``BUCKETS`` sums of a step come to the driver. Scoring is row by row, without a shuffle.

A null url, or one without ``://``, has an empty host and path; no rule fits it and the model scores its
empty features. Repeated urls get equal verdicts. Very long urls are used whole. Extra columns are not
read. Without labelled rows the weights are zero and the verdict is ``allow``.
"""

from pyspark.sql import functions as F

from drawfield.llm.common import query, stored, table

# Fixed values: (host, path, verdict), as the rules are given.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))

BUCKETS = 2048
GRAM = 3
MOST_LABELLED = 4096
STEPS, RATE, SHRINK = 32, 1.5, 1e-4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url):
    """``(host, path)`` as columns."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host, path, rules=RULES):
    """``(rule, verdict)`` of the longest rule that fits, as columns; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def buckets(host, path, size=BUCKETS):
    """The distinct buckets of a url's n-grams, as an array column."""
    def grams(text, mark):
        letters = F.concat(F.array(F.lit("^")), F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)),
                           F.array(F.lit("$")))
        last = F.size(letters) - GRAM
        return F.transform(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
                           lambda i: F.concat(F.lit(mark), *[F.get(letters, i + k) for k in range(GRAM)]))
    every = F.concat(grams(host, "h:"), grams(path, "p:"))
    return F.array_distinct(F.transform(every, lambda g: F.pmod(F.xxhash64(g), F.lit(size)).cast("int")))


def probability(features, weights, bias):
    """The model's probability of ``block``. Weights travel as one constant of fixed length."""
    constant = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate(features, F.lit(float(bias)), lambda a, i: a + F.get(constant, i))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def train(labelled, steps=STEPS, rate=RATE, size=BUCKETS, most=MOST_LABELLED):
    """Weights and bias from ``url``, ``block`` (0 or 1), by gradient steps over at most ``most`` different rows."""
    each = labelled.filter("url IS NOT NULL").groupBy("url", "block").agg(F.count(F.lit(1)).alias("times"))
    few = each.orderBy(F.xxhash64("url"), "url", "block").limit(most)
    host, path = split_url(F.col("url"))
    rows = stored(few.select(buckets(host, path, size).alias("features"), F.col("block").cast("double").alias("y"), "times"),
                  "labelled-urls")
    weights, bias = [0.0] * size, 0.0
    n, held = rows.agg(F.sum("times"), F.sum(F.col("times") * F.size("features"))).first()
    spread = max(1.0, held / n) if n else 1.0
    for _ in range(steps if n else 0):
        miss = rows.select("features", ((probability(F.col("features"), weights, bias) - F.col("y")) * F.col("times")).alias("miss"))
        # One row a bucket, and -1 for the bias.
        sums = (miss.select(F.explode(F.concat("features", F.array(F.lit(-1)))).alias("bucket"), "miss")
                .groupBy("bucket").agg(F.sum("miss").alias("slope")).collect())
        slopes = {r[0]: r[1] / n for r in sums}
        bias -= rate / spread * slopes.get(-1, 0.0)
        weights = [w - rate * (slopes.get(i, 0.0) + SHRINK * w) for i, w in enumerate(weights)]
    return weights, bias


def filter_urls(pages, labelled, rules=RULES):
    """``pages`` (``page_id``, ``url``) with ``host``, ``path``, ``rule``, ``verdict``, ``block_probability``."""
    weights, bias = train(labelled)
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    score = probability(buckets(F.col("host"), F.col("path")), weights, bias)
    return (rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"),
                        score.alias("block_probability"))
            .select("page_id", "host", "path", "rule",
                    F.coalesce("said", F.when(F.col("block_probability") > 0.5, F.lit("block"))
                               .otherwise(F.lit("allow"))).alias("verdict"), "block_probability"))


def labelled_by_rules(pages, rules=RULES):
    """A labelled url table: the urls that the rules decide."""
    host, path = split_url(F.col("url"))
    parts = pages.select("url", host.alias("host"), path.alias("path"))
    _, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return (parts.select("url", verdict.alias("verdict")).filter("verdict IS NOT NULL")
            .select("url", (F.col("verdict") == "block").cast("int").alias("block")))


@query("op2_url_filter")
def op2_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, labelled_by_rules(pages))
