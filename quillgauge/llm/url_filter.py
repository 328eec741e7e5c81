"""URL filters: rules for hosts and paths, and a logistic regression for the rest.

The regression sees the presence of hashed character n-grams of host and path.
It is trained on a small labelled table of urls by gradient descent, each step
one aggregate over the table; all of it is DataFrame expressions.  Sums are
taken over scaled integers, so the model does not depend on their order.  The
table is built by rule from words of unwanted and of ordinary sites, chosen for
it; nothing in it is taken from the pages that are judged.

Hosts are mostly made of words that the table has not.  So beside the model a
few others are trained in the same steps, each without the urls of a share of
the words, and the intercept is set so that ``FALSE_BLOCKS`` of the ordinary
hosts are blocked below a path that tells nothing, when judged by the model that
has not seen their words.

Edge cases: a null url, or one without ``://``, has an empty host and path; a
url too short for an n-gram is judged by the intercept; a very long url is
judged whole; of rules that fit the longest wins, of equally long ones the first
in code-point order; a score of exactly one half allows; with no labelled rows
all weights are zero and the verdict is allow; repeated rows are judged alike;
an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import settle

ALLOW, BLOCK = "allow", "block"
#: Rules in the form host/path; each fits its host and all subdomains if the path starts with the rule's.
RULES = {"org/": ALLOW, "example.org/es/": BLOCK, "example.org/en/1": BLOCK, "com/fr/": ALLOW, "com/de/": BLOCK}
#: Words of unwanted and of ordinary sites, and endings of paths, that the labelled table is built from: a choice, to be replaced by a table of one's own.
UNWANTED = """casino poker jackpot roulette slots betting wager lottery bingo blackjack porn xxx escort webcam nude hookup milf fetish viagra cialis
pills steroids pharmacy weightloss payday loans forex crypto giveaway prize crack keygen torrent warez serial phishing verify-account login-update
free-download clickbait adserver tracker popunder backlinks linkfarm replica counterfeit followers spam""".split()
ORDINARY = """library museum university school hospital council parliament observatory orchestra theatre gallery archive newspaper weather travel railway airport
garden bakery recipes kitchen furniture books music cinema football cycling climbing sailing forest mountain river chemistry physics biology
mathematics linguistics history geography philosophy software database compiler network documents support forum community blog notes letters
painting pottery carpentry architecture engineering insurance bank market grocery clothing shoes toys parenting health dentist clinic charity
volunteers church election court tax water energy recycling transport bridge harbour farm dairy vineyard coffee restaurant hotel camping""".split()
UNWANTED_PATHS = ("/", "/play-now", "/bonus?code=1", "/win/free", "/click.php", "/buy-cheap", "/join", "/hot/live", "/offer/best-price", "/cam")
ORDINARY_PATHS = ("/", "/about", "/articles/2021/spring", "/index.html", "/contact", "/catalogue/item-204", "/docs/getting-started", "/people/staff", "/events?month=5", "/archive/page/12/")
ENDINGS = (".com", ".net", ".org", ".info", ".co.uk", ".eu", ".io")
BUCKETS = 2048
WIDTHS = (3, 4)
#: Labelled urls that training uses at most: the first by a hash of the url.
MAX_ROWS = 4000
STEPS, RATE, RIDGE = 30, 4.0, 0.001
SCALE = 1 << 30
#: Shares that the words are dealt to, and the part of unseen ordinary urls that may be blocked.
FOLDS, FALSE_BLOCKS = 4, 0.05


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, else null; among rules of one length the first in code-point order."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: dict[str, str] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules.items():
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def features(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Distinct buckets of the n-grams of ^host$ and of the path, marked by which of the two they are from."""
    parts = []
    for tag, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(path, F.lit("$")))):
        for width in WIDTHS:
            grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1))
            parts.append(F.transform(grams, lambda g, tag=tag: F.pmod(F.xxhash64(F.lit(tag), g), F.lit(buckets)).cast("int")))
    return F.array_distinct(F.concat(*parts))


@dataclass(frozen=True)
class Model:
    """Weights of the buckets; the last is the intercept."""

    weights: tuple[float, ...]

    def literal(self) -> Column:
        return F.expr(f"cast(split('{','.join(f'{w:.9g}' for w in self.weights)}', ',') as array<double>)")

    def margin(self, found: Column) -> Column:
        """Log-odds of block."""
        w = self.literal()
        return F.aggregate(found, F.lit(float(self.weights[-1])), lambda acc, i: acc + F.element_at(w, i + 1))


def fit(labelled: DataFrame, buckets: int = BUCKETS, steps: int = STEPS, max_rows: int = MAX_ROWS, folds: int = FOLDS) -> tuple[list[Model], DataFrame]:
    """A model without each fold and one of all rows, and the rows (y, fold, found, plain); labelled: host, path, verdict, fold."""
    rows = labelled.select("host", "path", (F.col("verdict") == BLOCK).cast("int").alias("y"), "fold").distinct()
    rows = rows.orderBy(F.xxhash64("host", "path"), "host", "path", "y", "fold").limit(max_rows)
    # a feature's share of the step: long urls do not outweigh short ones
    plain = features(F.col("host"), F.lit("/"), buckets).alias("plain")
    data = settle(rows.select("y", "fold", features(F.col("host"), F.col("path"), buckets).alias("found"), plain), "urls").coalesce(1)
    used = data.select("*", F.explode(F.sequence(F.lit(0), F.lit(folds))).alias("m")).where("m <> fold")
    sizes = {r.m: r["count"] for r in used.groupBy("m").count().collect()}  # a row a model
    weights = [[0.0] * (buckets + 1) for _ in range(folds + 1)]
    for _ in range(steps if sizes else 0):
        odds = F.coalesce(*[F.when(F.col("m") == m, Model(tuple(w)).margin(F.col("found"))) for m, w in enumerate(weights)])
        off = F.col("y") - 1 / (1 + F.exp(-odds))
        each = used.select("m", F.round(off * SCALE / F.sqrt(F.size("found") + 1)).cast("long").alias("g"), F.explode(F.concat("found", F.array(F.lit(buckets)))).alias("i"))
        for m, i, g in each.groupBy("m", "i").agg(F.sum("g")).collect():  # one number a model and bucket
            weights[m][i] += RATE * (g / SCALE / sizes[m] * 10 - RIDGE * (weights[m][i] if i < buckets else 0))
    return [Model(tuple(w)) for w in weights], data


def unseen_margins(models: list[Model], data: DataFrame, found: str = "found") -> DataFrame:
    """y, margin of each row by the model that has not seen its fold; of its host alone with ``plain``."""
    return data.select("y", F.coalesce(*[F.when(F.col("fold") == m, model.margin(F.col(found))) for m, model in enumerate(models[:-1])]).alias("margin"))


def train(labelled: DataFrame, buckets: int = BUCKETS, steps: int = STEPS, max_rows: int = MAX_ROWS, false_blocks: float = FALSE_BLOCKS) -> Model:
    """Fit on rows (host, path, verdict, fold), at most ``max_rows`` distinct ones, and set the intercept on those not seen."""
    models, data = fit(labelled, buckets, steps, max_rows)
    least = unseen_margins(models, data, "plain").where("y = 0").agg(F.percentile("margin", 1 - false_blocks)).first()[0]
    weights = list(models[-1].weights)
    weights[-1] -= max(least or 0.0, 0.0)
    return Model(tuple(weights))


def table_of(words: list[str], paths: tuple[str, ...], folds: int = FOLDS) -> list[tuple[str, int]]:
    """Urls of hosts named after one word or two, below the usual subdomains, and their fold; no word is in two folds."""
    out = []
    for i, word in enumerate(words):
        fold = i % folds
        own = words[fold::folds]
        other = own[(i // folds * 3 + 1) % len(own)]
        names = (word, f"{word}-{other}", f"{word}{other}", f"my{word}", f"{word}{i + 11}")
        for j, name in enumerate(names):
            url = f"http{'s' * (j % 2)}://{('', 'www.', 'm.', 'blog.')[(i + j) % 4]}{name}{ENDINGS[(i + 2 * j) % len(ENDINGS)]}{paths[(i + 3 * j) % len(paths)]}"
            out.append((url, fold))
    return out


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled table as rows (host, path, verdict, fold)."""
    rows = [(u, BLOCK, f) for u, f in table_of(UNWANTED, UNWANTED_PATHS)] + [(u, ALLOW, f) for u, f in table_of(ORDINARY, ORDINARY_PATHS)]
    one = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(u).alias("url"), F.lit(v).alias("verdict"), F.lit(f).alias("fold")) for u, v, f in rows])).alias("r"))
    return one.select(host_of(F.col("r.url")).alias("host"), path_of(F.col("r.url")).alias("path"), "r.verdict", "r.fold")


def judge(pages: DataFrame, rules: dict[str, str] = RULES, model: Model | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score (probability of block by the method)."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    told = verdict_of(F.col("rule"), rules)
    model = model or train(labelled_urls(pages.sparkSession))
    scored = ruled.withColumn("score", 1 / (1 + F.exp(-model.margin(features(F.col("host"), F.col("path"), len(model.weights) - 1)))))
    learned = F.when(F.col("score") > 0.5, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return scored.select("page_id", "host", "path", "rule", F.coalesce(told, learned).alias("verdict"), "score")
