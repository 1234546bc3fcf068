"""URL filters: host and path rules, then a blocked Bloom filter in front of an exact hash join.

The list holds canonical URLs: host lower-cased without a leading ``www.``, then the path without
trailing slashes; an entry with the path ``/`` stands for the whole site with its subdomains. A page
is looked up under its own canonical URL and under each of its host's suffixes. The Bloom filter is
register-blocked: a key sets four bits of one 64-bit word. Its words grow with the list, 16 bits a URL; up to ``MOST_WORDS`` words
are broadcast, and a larger filter is joined by its words' numbers, partition by partition. The hash join with the list removes every false hit.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed. Repeated rows are judged row by row. Other columns are dropped, whatever their names. URLs of any length are read whole; of rules of equal
length the first by name wins. An empty table gives no rows, and an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (rule, verdict); a rule is a host and a path prefix.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Sites that are blocked where no rule decides, and pages of other sites: every ``PAGE_STEP``-th number of PAGES_OF's sites in each language.
SITES = [f"{name}.example.{tld}/" for name in ("spam-farm", "cheap-pills") for tld in ("org", "net", "com")]
PAGES_OF, LANGUAGES, MOST_PAGE, PAGE_STEP = ["blog.tionsh.example.com", "tiontion.example.net", "m.ththth.example.net", "ththan.example.com"], ["en", "es", "fr", "de"], 1000, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_RULES, MOST_WORDS = 256, 1 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null if none fits. At most MOST_RULES rules."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are compiled into the plan")
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, slash, tail = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + tail)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def bloom_parts(key: Column, words: int) -> tuple[Column, Column]:
    """A key's block and its four bits in that block's word."""
    h = F.xxhash64(F.lit("bits"), key)
    bits = F.lit(0).cast("long")
    for i in range(4):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", h, F.lit(6 * i)).bitwiseAND(F.lit(63)).cast("int")))
    return F.pmod(F.xxhash64(key), F.lit(words)), bits


def bloom_table(listed: DataFrame) -> tuple[DataFrame, int]:
    """(block, word) of the list's canonical URLs, and the number of blocks: a power of two of about 16 bits a URL."""
    n = listed.count()
    words = 64
    while words * 4 < n:
        words *= 2
    block, bits = bloom_parts(F.col("canonical"), words)
    return listed.select(block.alias("block"), bits.alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("word")), words


def listed_urls(spark: SparkSession) -> DataFrame:
    """The list, as canonical URLs: the sites and, by rule, the pages."""
    sites = spark.createDataFrame([(x,) for x in SITES], "canonical string")
    pages = spark.range(0, MOST_PAGE, PAGE_STEP).select("id", F.explode(F.array(*map(F.lit, PAGES_OF))).alias("host")).select("id", "host", F.explode(F.array(*map(F.lit, LANGUAGES))).alias("lang"))
    return sites.unionByName(pages.select(F.concat_ws("/", "host", "lang", F.col("id").cast("string")).alias("canonical")))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], most_words: int = MOST_WORDS) -> DataFrame:
    """page_id, host, path, rule, verdict and listed of every row of pages; listed has a column canonical."""
    host, path = host_and_path(F.col("url"))
    own = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    listed = listed.select("canonical").where("canonical is not null").distinct()
    table, words = bloom_table(listed)

    site = F.regexp_replace("host", r"^www\.", "")
    labels = F.split(site, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, i, F.size(labels)), "."), F.lit("/")))
    page = F.concat(site, F.regexp_replace("path", "/+$", ""))
    keys = own.where("host <> ''").select("url", "host", "path").distinct().select("url", F.explode(F.array_distinct(F.concat(suffixes, F.array(page)))).alias("canonical"))
    block, bits = bloom_parts(F.col("canonical"), words)
    maybe = keys.withColumns({"block": block, "bits": bits}).join(F.broadcast(table) if words <= most_words else table, "block").where(F.col("word").bitwiseAND(F.col("bits")) == F.col("bits"))
    hits = maybe.join(listed, "canonical", "left_semi").select("url").distinct().withColumn("hit", F.lit(True))
    out = own.join(hits, "url", "left").withColumns({"rule": rule, "said": verdict, "listed": F.coalesce("hit", F.lit(False))})
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), listed_urls(spark), RULES)


def _sql() -> str:
    """The same rows in DuckDB."""
    cases = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    fits = {t: f"((host = '{t.partition('/')[0]}' or ends_with(host, '.{t.partition('/')[0]}')) and starts_with(path, '/{t.partition('/')[2]}'))" for t, _ in cases}
    rule = "case " + " ".join(f"when {fits[t]} then '{t}'" for t, _ in cases) + " end"
    says = "case " + " ".join(f"when {fits[t]} then '{v}'" for t, v in cases) + " end"
    sites = " or ".join(f"site = '{x[:-1]}' or ends_with(site, '.{x[:-1]}')" for x in SITES)
    pages = f"site || '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3) = site || regexp_replace(path, '/+$', '') and list_contains({PAGES_OF}, site) and list_contains({LANGUAGES}, split_part(path, '/', 2)) and regexp_matches(path, '^/[a-z]+/(0|[1-9][0-9]*)/*$') and regexp_extract(path, '^/[a-z]+/([0-9]+)/*$', 1) in (select i::varchar from range(0, {MOST_PAGE}, {PAGE_STEP}) t(i))"
    return f"""
with a as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
b as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') host,
 regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) path from a),
c as (select *, regexp_replace(host, '^www\\.', '') site from b),
d as (select *, {rule} as rule, {says} as said, (({sites}) or ({pages})) as listed from c)
select page_id, host, path, rule, coalesce(said, case when listed then 'block' else 'allow' end) verdict, listed from d"""


QUERIES = {"op2_url_filter": op2_url_filter}
ORACLE = {"op2_url_filter": _sql()}
