"""URL filters with redirect equivalence: block decisions reach all aliases of a page, explicit allows come first."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written
from .components import connected_components


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: Rules are compiled into the plan; far larger lists belong in a table.
MOST_RULES = 2_000

# Patterns of the SQL, which follows the first tag of a kind only; Java and RE2 read them alike.
CANONICAL_TAG = r"(?i)<link[^>]*rel\s*=\s*[\"']?canonical[^>]*>"
HREF = r"(?i)href\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_TAG = r"(?i)<meta[^>]*http-equiv\s*=\s*[\"']?refresh[^>]*>"
REFRESH_URL = r"(?i)url\s*=\s*[\"']?([^\"'\s>]+)"

# Patterns of page_edges.
LINK_TAGS = r"(?i)<link\b[^>]*+>"
META_TAGS = r"(?i)<meta\b[^>]*+>"
#: What the content of a refresh names, after its seconds.
REFRESH_CONTENT = r"(?i)^\s*(?:[0-9.]++[\s;,]++|(?=url\s*=))(?:url\s*=\s*)?+[\"']?\s*([^\"'\s]+)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"

#: What stands before the first '://', the host, the path, the query.
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)"


def _part(url: Column, group: int) -> Column:
    """A part of a url, empty where it has none; of null and of a text without '://' all parts are empty."""
    return F.coalesce(F.regexp_extract(url, _URL, group), F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(_part(url, 1))


def path_of(url: Column) -> Column:
    return _part(url, 2)


def node_of(url: Column) -> Column:
    """A page under any scheme and fragment: host, path and query; empty where there is no host."""
    return F.when(_part(url, 1) != "", F.concat(host_of(url), _part(url, 2), _part(url, 3))).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does: host or a subdomain, and the path's beginning. Equal lengths: allow first, then by text."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.verdict, r.text), reverse=True):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, empty where it has none."""
    pattern = rf"""(?i)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.trim(F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)]))


def _targets(html: Column, word: str, tags: str, of) -> Column:
    """What all tags of a kind name, empty texts among it; only pages that hold the word are searched."""
    found = F.transform(F.regexp_extract_all(html, F.lit(tags), F.lit(0)), lambda tag: F.replace(of(tag), F.lit("&amp;"), F.lit("&")))
    return F.when(F.contains(F.lower(html), F.lit(word)), found).otherwise(F.array().cast("array<string>"))


def _canonical(tag: Column) -> Column:
    rel = F.split(F.lower(_attribute(tag, "rel")), r"\s+")
    return F.when(F.array_contains(rel, "canonical"), _attribute(tag, "href")).otherwise("")


def _refresh(tag: Column) -> Column:
    return F.when(F.lower(_attribute(tag, "http-equiv")) == "refresh", F.regexp_extract(_attribute(tag, "content"), REFRESH_CONTENT, 1)).otherwise("")


def _without_dots(path: Column) -> Column:
    """A path from the root without its segments '.' and '..'."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == ".", kept).when(part == "..", up).otherwise(F.concat(kept, F.array(part)))

    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"), step)
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(F.contains(path, F.lit("/.")), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def resolved(to: Column, url: Column) -> Column:
    """A link's target as a whole url, as RFC 3986 resolves it against the page's url; empty for other schemes and for places in the page itself."""
    to = F.regexp_extract(to, r"(?s)^([^#]*)", 1)
    path, query = F.regexp_extract(to, r"(?s)^([^?]*)", 1), F.regexp_extract(to, r"(?s)^[^?]*(.*)$", 1)
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    root = F.concat(F.lit("http://"), host_of(url))
    here = F.when(path == "", path_of(url)).when(path.startswith("/"), _without_dots(path)).otherwise(_without_dots(F.concat(folder, path)))
    whole = F.when(to.rlike(SCHEME + "//"), to).when(to.startswith("//"), F.concat(F.lit("http:"), to))
    return whole.when((to == "") | to.rlike(SCHEME) | (host_of(url) == ""), "").otherwise(F.concat(root, here, query))


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b) of all canonical links and redirects that pages state in their html, canonical being one word of a link's rel. Relative targets are resolved against the page's url; base tags aren't read."""
    html = F.coalesce("html", F.lit(""))
    targets = F.concat(_targets(html, "canonical", LINK_TAGS, _canonical), _targets(html, "refresh", META_TAGS, _refresh))
    raw = pages.select("url", F.explode(F.array_distinct(targets)).alias("to")).where("to != ''")
    ends = raw.select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("to"), F.col("url"))).alias("b"))
    return ends.where("a != '' and b != '' and a != b")


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, component (null without aliases).

    A url's own rule decides, so an explicit allow holds whatever its aliases are. A page without a rule is blocked if any url of
    its component of redirect and canonical-link edges is blocked by a rule, whether that url is among the pages or not, and else
    allowed. redirects: further edges (src, dst: urls). Nodes are the urls' texts, so nothing rests on hashes; schemes and fragments don't tell urls apart.
    Null and malformed urls have empty host and path, no rule and no aliases; null html has no links; repeated rows are judged alike.
    """
    edges = page_edges(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b")).where("a != '' and b != ''"))
    members = written(connected_components(edges), "url-components")
    host, path = F.regexp_extract("node", r"^([^/?]*)", 1), F.regexp_extract("node", r"^[^/?]*([^?]*)", 1)
    blocked = members.groupBy("component").agg(F.max(F.coalesce(rule_of(host, path, rules)["verdict"] == "block", F.lit(False))).alias("blocked"))
    blocked = written(members.join(blocked, "component").select("node", "component", "blocked"), "url-blocked")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.when(node_of(F.col("url")) != "", node_of(F.col("url"))).alias("node"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).join(blocked, "node", "left")
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "component")


def url_table(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url", "html")).drop("component")


def _sql() -> str:
    rest = "case when strpos({u}, '://') > 0 then substr({u}, strpos({u}, '://') + 3) else '' end"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda u: lower.format(f"regexp_extract({rest.format(u=u)}, '^([^/?#]*)', 1)")
    path = lambda u: f"regexp_extract({rest.format(u=u)}, '^[^/?#]*([^?#]*)', 1)"
    node = lambda u: f"nullif({host(u)}, '') || regexp_extract({rest.format(u=u)}, '^[^/?#]*([^#]*)', 1)"
    q = lambda s: s.replace("'", "''").replace('\\"', '"')
    target = lambda tag, value: f"replace(regexp_extract(regexp_extract(html, '{q(tag)}', 0), '{q(value)}', 1), '&amp;', '&')"
    full = "case when strpos(t, '://') > 0 then t when starts_with(t, '//') then 'http:' || t when starts_with(t, '/') and h <> '' then 'http://' || h || t end"
    rule = lambda what, h, p: "case " + " ".join(f"when ({h} = '{r.host}' or ends_with({h}, '.{r.host}')) and starts_with({p}, '{r.path}') then '{getattr(r, what)}'" for r in sorted(RULES, key=lambda r: (-len(r.text), r.verdict, r.text))) + " end"
    return f"""
with recursive p as (select row_number() over () as rid, page_id, {host('url')} as host, {path('url')} as path, {node('url')} as node, html, {host('url')} as h from pages),
t as (select node, h, unnest([{target(CANONICAL_TAG, HREF)}, {target(REFRESH_TAG, REFRESH_URL)}]) as t from p),
e as (select distinct node as a, {node('(' + full + ')')} as b from t where t <> ''),
links as (select a, b from e where a <> b union select b, a from e where a <> b),
reach as (select distinct a as node, a as other from links union select r.node, l.b from reach r join links l on r.other = l.a),
bad as (select node from reach group by node having bool_or({rule('verdict', "regexp_extract(other, '^([^/?]*)', 1)", "regexp_extract(other, '^[^/?]*([^?]*)', 1)")} = 'block'))
select page_id, host, path, {rule('text', 'host', 'path')} as rule, coalesce({rule('verdict', 'host', 'path')}, case when bad.node is not null then 'block' else 'allow' end) as verdict
from p left join bad on p.node = bad.node
"""


URL_ORACLE = _sql()
