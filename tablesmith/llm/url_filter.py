"""URL filter: given host and path rules first, then association rules that FP-growth mines from labelled URLs.

A URL's tokens are its host, the host's ends (``com``, ``example.com`` ...), its path segments and the keys of its query. Labelled
URLs and their label are transactions for Spark's FPGrowth; tokens that always occur together are one item there. Rules that conclude the bad label are kept if their support,
confidence and lift suffice and no rule of fewer tokens with as much confidence is within them. Matching goes by an inverted index from token to
rule: a rule fires on a URL that has as many of its tokens as the rule has.

Of given rules of equal length that fit, the one given last wins; of mined rules that fire, the one of the lowest number. URLs of any
length are read whole.

Edge cases: a null URL or one without ``://`` has an empty host and path, no tokens and the verdict ``allow``; repeated rows are judged alike; without labels,
or with too few for the support, there are no mined rules; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.llm.components import cut, small

BAD = "label=bad"


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL; none without ``://``."""
    labels = F.split(host(url), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    segments = F.transform(F.filter(F.split(path(url), "/"), lambda s: s != ""), lambda s: F.concat(F.lit("path="), s))
    query = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1), "&")
    keys = F.transform(F.filter(query, lambda k: k != ""), lambda k: F.concat(F.lit("query="), F.split(k, "=")[0]))
    return F.when(F.coalesce(url, F.lit("")).contains("://"), F.array_distinct(F.concat(ends, segments, keys))).otherwise(F.array().cast("array<string>"))


def given_rule(host_col: Column, path_col: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest of ``rules`` (verdict, host, path) that fits, as text, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host_col == h) | host_col.endswith(f".{h}")) & path_col.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def mine(urls: DataFrame, bad: Column, url_col: str = "url", least: int = 20, support: float = 0.002, confidence: float = 0.5, lift: float = 1.5) -> DataFrame:
    """``rule`` (number), ``antecedent`` (array of tokens), ``confidence`` and ``lift`` from labelled URLs.

    A rule needs ``support`` of the labelled rows and at least ``least`` of them.
    """
    rows = cut(urls.select(tokens(F.col(url_col)).alias("tokens"), F.coalesce(bad, F.lit(False)).alias("bad"), F.monotonically_increasing_id().alias("row")))
    n, n_bad = rows.agg(F.count("*"), F.sum(F.col("bad").cast("long"))).first()
    none = urls.sparkSession.createDataFrame([], "rule long, antecedent array<string>, confidence double, lift double")
    if not n_bad or n_bad < least:
        return none
    classes = _classes(rows, max(support * n, least))
    names = cut(classes.select(F.explode("members").alias("token"), F.col("members")[0].alias("name")))
    items = rows.select("row", F.explode("tokens").alias("token")).join(small(names, names.count()), "token").groupBy("row").agg(F.collect_set("name").alias("items"))
    empty = F.array().cast("array<string>")
    baskets = rows.join(items, "row", "left").select(F.concat(F.coalesce("items", empty), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(empty)).alias("items"))
    from pyspark.ml.fpm import FPGrowth  # here, so that other queries' drivers do without the library

    model = FPGrowth(itemsCol="items", minSupport=max(support, least / n), minConfidence=0.0).fit(baskets)
    found = cut(model.associationRules.filter(F.col("consequent")[0] == BAD).select(F.sort_array("antecedent").alias("antecedent"), "confidence", "lift"))
    kept = _spelled_out(minimal(found).filter((F.col("confidence") >= confidence) & (F.col("lift") >= lift)), classes)
    ordered = kept.orderBy(F.desc("confidence"), F.size("antecedent"), F.array_join("antecedent", " "))
    placed = cut(ordered.select("*", F.monotonically_increasing_id().alias("m"))).withColumn("part", F.shiftright("m", 33))
    before = placed.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))  # a row for each partition
    number = (F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("rule")
    return cut(placed.join(F.broadcast(before), "part").select(number, "antecedent", "confidence", "lift"))


def _classes(rows: DataFrame, least: float) -> DataFrame:
    """``members``: tokens that stand in exactly the same rows, each token of at least ``least`` bad rows in one class.

    A class is one item for FP-growth, whose sets would double with each token of it. Rows are compared by their number and two sums of hashes.
    """
    each = rows.select("row", "bad", F.explode("tokens").alias("token"))
    same = [F.sum(F.xxhash64("row", F.lit(salt)).cast("decimal(38,0)")).alias(f"h{salt}") for salt in (0, 1)]
    found = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), *same).filter(F.col("n_bad") >= least)
    return cut(found.groupBy("n", "n_bad", "h0", "h1").agg(F.sort_array(F.collect_list("token")).alias("members")).select("members"))  # at most the tokens of one URL


def _spelled_out(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Rules over classes as rules over tokens: one for each choice of a token from each class."""
    numbered = cut(rules.select("*", F.monotonically_increasing_id().alias("id")))
    groups = numbered.select("id", F.explode("antecedent").alias("name")).join(classes.select(F.col("members")[0].alias("name"), "members"), "name").groupBy("id").agg(F.collect_list("members").alias("groups"))
    start = F.array(F.array().cast("array<string>"))
    choices = F.aggregate("groups", start, lambda done, group: F.flatten(F.transform(done, lambda d: F.transform(group, lambda t: F.concat(d, F.array(t))))))
    return numbered.join(groups, "id").select(F.explode(choices).alias("antecedent"), "confidence", "lift").select(F.sort_array("antecedent").alias("antecedent"), "confidence", "lift")


def minimal(rules: DataFrame) -> DataFrame:
    """The rules (every subset of an antecedent has one) without a rule of fewer tokens and as much confidence within them.

    Size by size: the best confidence within a rule is that of its subsets of one token less, so each rule is joined to those only.
    """
    most = rules.agg(F.max(F.size("antecedent"))).first()[0]
    out, below = rules.filter(F.size("antecedent") == 1), rules.filter(F.size("antecedent") == 1).select("antecedent", F.col("confidence").alias("top"))
    for size in range(2, (most or 0) + 1):
        own = rules.filter(F.size("antecedent") == size)
        less = own.select(F.col("antecedent").alias("whole"), F.explode("antecedent").alias("token")).select("whole", F.array_remove("whole", F.col("token")).alias("antecedent"))
        within = less.join(below, "antecedent").groupBy("whole").agg(F.max("top").alias("within")).withColumnRenamed("whole", "antecedent")
        own = cut(own.join(within, "antecedent", "left").withColumn("within", F.coalesce("within", F.lit(0.0))))
        out = out.unionByName(own.filter("within < confidence").select(*rules.columns))
        below = own.select("antecedent", F.greatest("confidence", "within").alias("top"))
    return out


def fired(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``url`` and ``mined_rule`` (the lowest number) of each distinct URL on which a mined rule fires."""
    index = rules.select("rule", F.size("antecedent").alias("size"), F.explode("antecedent").alias("token"))
    seen = urls.select(F.col(url_col).alias("url")).filter(F.col("url").contains("://")).distinct().select("url", F.explode(tokens(F.col("url"))).alias("token"))
    hits = seen.join(small(index, index.count()), "token").groupBy("url", "rule", "size").agg(F.count("*").alias("n"))
    return hits.filter("n = size").groupBy("url").agg(F.min("rule").alias("mined_rule"))


def judge(pages: DataFrame, labels: DataFrame | None, bad: Column, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", label_id_col: str = "doc_id", **mining) -> DataFrame:
    """``id_col``, ``url``, ``host``, ``path``, ``rule``, ``mined_rule`` and ``verdict`` of every page.

    ``labels`` (key ``label_id_col``, condition ``bad`` over its columns) are joined to pages by id for mining.
    """
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    out = own.withColumn("mined_rule", F.lit(None).cast("long"))
    if labels is not None:
        known = own.join(labels.select(F.col(label_id_col).alias("id"), F.coalesce(bad, F.lit(False)).alias("bad")), "id")
        mined = mine(known, F.col("bad"), "url", **mining)
        if not mined.isEmpty():
            hits = cut(fired(own, mined))
            has = F.coalesce(F.col("url").contains("://"), F.lit(False))  # the others, null above all, stay out of the join
            out = own.filter(has).join(small(hits, hits.count()), "url", "left").unionByName(out.filter(~has))
    h, p = host(F.col("url")), path(F.col("url"))
    name, said = given_rule(F.col("host"), F.col("path"), rules)
    out = out.select(F.col("id").alias(id_col), "url", h.alias("host"), p.alias("path"), "mined_rule")
    return out.select(id_col, "url", "host", "path", name.alias("rule"), "mined_rule", F.coalesce(said, F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
