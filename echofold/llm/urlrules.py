"""URL filter: pattern rules indexed by their rarest literal token, in DataFrame functions only.

A rule names literal tokens that every URL it matches must have. Its index entry stands under the one that
fewest URLs of the table hold; a URL's own tokens then fetch the candidate rules, and only those run
their regular expressions, over ``host || path``. The longest matching rule decides; of equally long ones
a block before an allow, then the greater text. Rules without a literal token are candidates of every URL.

A rule set of at most ``INLINE_RULES`` travels inside the plan, so that URLs are judged in one pass without
a shuffle. A larger one is a table (``judge_table``): its tokens are counted, its rarest ones found and its candidates
fetched by joins on tokens, per distinct URL, and Spark chooses each join by its size.

Defined results: a null url, or one without ``://``, has an empty host and path, no candidates but the
token-less rules, and else the default verdict. Repeated rows are judged alike. Columns of the input are
kept if they do not clash with host, path, rule, verdict and method_rule; clashing ones are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INLINE_RULES = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OUT = ("host", "path", "rule", "verdict", "method_rule")


@dataclass(frozen=True)
class Rule:
    """name: what is reported; rank: its class (of classes that match, the highest decides); tokens: literal tokens that a match must have."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...] = ()
    rank: int = 0

    @classmethod
    def site(cls, host: str, path: str, action: str) -> Rule:
        """A host with all its subdomains and a path prefix."""
        whole = re.findall(r"[a-z0-9]+", host)
        folders = re.findall(r"(?<=/)[a-z0-9]+(?=/)", path)
        return cls(f"{host}{path}", action, rf"^([^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(whole + folders), 1)

    @classmethod
    def word(cls, word: str, action: str) -> Rule:
        """A word that stands alone between non-alphanumeric characters, in the host or the path."""
        return cls(word, action, rf"(^|[^a-z0-9]){re.escape(word)}([^a-z0-9]|$)", (word,))


    @classmethod
    def folder(cls, name: str, action: str) -> Rule:
        """A whole folder or file name of the path."""
        return cls(f"/{name}/", action, rf"/{re.escape(name)}(/|\z)", tuple(re.findall("[a-z0-9]+", name)))

    @classmethod
    def ending(cls, name: str, action: str) -> Rule:
        """What a path ends with, after a dot."""
        return cls(f".{name}", action, rf"/[^/]*\.{re.escape(name)}\z", (name,))


#: The production rules.
SITES = (
    Rule.site("com", "/", "allow"),
    Rule.site("example.com", "/en/", "block"),
    Rule.site("www.example.com", "/en/", "allow"),
    Rule.site("net", "/es/", "block"),
    Rule.site("net", "/fr/", "block"),
)
#: Where no site rule fits, a URL is blocked that names one of these words, lies in one of these folders (forms, advertising,
#: listings without text of their own), ends as a file that is no page, or has a part that no page has: an address as its
#: host, a session's id, a calendar's day.
WORDS = ("adult", "betting", "casino", "escort", "malware", "phishing", "porn", "spam", "torrent", "viagra", "warez", "xxx")
FOLDERS = (
    "ads", "advert", "affiliate", "banner", "banners", "cart", "cgi-bin", "checkout", "click", "doubleclick", "login", "logout", "popup", "print", "redirect", "register",
    "signin", "signup", "sponsor", "tracking", "unsubscribe", "wp-admin", "wp-login.php", "xmlrpc.php",
)
ENDINGS = ("apk", "avi", "bin", "css", "dmg", "exe", "gif", "gz", "ico", "iso", "jpeg", "jpg", "js", "mov", "mp3", "mp4", "msi", "png", "rar", "svg", "tar", "wav", "webp", "woff", "zip")
SHAPES = (
    Rule("numeric host", "block", r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+(:[0-9]+)?/"),
    Rule("session id", "block", r"/[^/]*(sessionid|phpsessid|jsessionid)[^a-z]"),
    Rule("calendar day", "block", r"/(calendar|events|archive)/[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}(/|\z)"),
)
METHOD = (*(Rule.word(w, "block") for w in WORDS), *(Rule.folder(f, "block") for f in FOLDERS), *(Rule.ending(e, "block") for e in ENDINGS), *SHAPES)


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(key, UPPER, LOWER), "[^a-z0-9]+"), lambda t: t != ""))


def key(url: Column) -> Column:
    return F.concat(host(url), path(url))


def token_counts(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """In how many rows each literal token of the rules occurs; tokens that no rule has are not counted."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    mine = F.array_intersect(tokens(key(F.col("url"))), F.array(*map(F.lit, wanted)))
    rows = urls.select(F.explode(mine).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()
    return {t: 0 for t in wanted} | {r.t: r.n for r in rows}


def index(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules under their rarest literal token; '' holds those that have none."""
    out: dict[str, list[Rule]] = {}
    for r in rules:
        out.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    return out


def entry(r: Rule) -> Column:
    """Comparable: of two structs the greater decides."""
    return F.struct(
        F.lit(r.rank).alias("rank"), F.lit(len(r.name)).alias("size"), F.lit(r.action).alias("action"),
        F.lit(r.name).alias("name"), F.lit(r.pattern).alias("pattern"),
    )


def best_inline(rows: DataFrame, by: dict[str, list[Rule]]) -> DataFrame:
    """Adds _best to rows that have _key."""
    always = F.array(*[entry(r) for r in by.get("", [])])
    held = sorted(t for t in by if t)
    kind = "array<struct<rank:int,size:int,action:string,name:string,pattern:string>>"
    found = always.cast(kind)
    if held:
        lists = F.create_map(*[x for t in held for x in (F.lit(t), F.array(*[entry(r) for r in by[t]]))])
        mine = F.array_intersect(tokens(F.col("_key")), F.array(*map(F.lit, held)))
        found = F.concat(found, F.flatten(F.transform(mine, lambda t: F.element_at(lists, t))).cast(kind))
    fits = F.filter(found, lambda r: F.rlike(F.col("_key"), r["pattern"]))
    return rows.withColumn("_best", F.array_max(fits))


RULES = "name string, action string, pattern string, tokens array<string>, rank int"


def best_joined(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """As best_inline, by joins on tokens of the distinct keys. rules: columns of RULES."""
    keys = rows.select("_key").distinct()
    split = keys.select("_key", F.explode(F.concat(tokens(F.col("_key")), F.array(F.lit("")))).alias("token"))
    each = rules.select("name", "action", "pattern", "rank", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    used = split.join(each.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))
    table = each.join(used, "token", "left").groupBy("name", "action", "pattern", "rank").agg(rarest.alias("m")).select("name", "action", "pattern", "rank", F.col("m.token").alias("token"))
    fits = split.join(table, "token").where("_key rlike pattern")
    best = fits.groupBy("_key").agg(F.max(F.struct("rank", F.char_length("name").alias("size"), "action", "name", "pattern")).alias("_best"))
    return rows.join(best, "_key", "left")


def parsed(urls: DataFrame) -> tuple[list[str], DataFrame]:
    """The columns to keep, and these with host, path and _key."""
    keep = [c for c in urls.columns if c.lower() not in OUT]
    rows = urls.select(*keep, host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    return keep, rows.withColumn("_key", F.concat("host", "path"))


def decided(keep: list[str], rows: DataFrame, default: str) -> DataFrame:
    site = F.col("_best.rank") > 0
    return rows.select(
        *keep, "host", "path",
        F.when(site, F.col("_best.name")).alias("rule"),
        F.coalesce(F.col("_best.action"), F.lit(default)).alias("verdict"),
        F.when(~site, F.col("_best.name")).alias("method_rule"),
    )


def judge_table(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """As judge, by a table of rules of any size (columns of RULES), which stays distributed."""
    keep, rows = parsed(urls)
    return decided(keep, best_joined(rows, rules), default)


def judge(urls: DataFrame, rules: tuple[Rule, ...], default: str = "allow", inline: bool | None = None) -> DataFrame:
    """Adds host, path, rule (a site rule's name, else null), verdict and method_rule (another rule's name)."""
    if not (len(rules) <= INLINE_RULES if inline is None else inline):
        table = urls.sparkSession.createDataFrame([(r.name, r.action, r.pattern, list(r.tokens), r.rank) for r in rules], RULES)
        return judge_table(urls, table, default)
    keep, rows = parsed(urls)
    return decided(keep, best_inline(rows, index(rules, token_counts(urls, rules))), default)


def production(spark: SparkSession, urls: DataFrame) -> DataFrame:
    return judge(urls, SITES + METHOD)
