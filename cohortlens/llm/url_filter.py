"""URL filters with redirect equivalence (operator 8).

A rule names a host and a path; it fits the host and its subdomains where the URL's path starts with the
rule's, and the longest fitting rule decides. Pages without a rule take the decision of their aliases. Aliases
are the URLs that lead to one another: each canonical link and meta refresh of a page is an edge between canonical
URLs, and URLs that differ only in scheme, a leading www. or m., fragment, tracking parameters, the order of
parameters, a closing slash or .html are one canonical URL to begin with. Connected components over these edges
collect the decisions; a component with a blocked and no allowed member is blocked, any explicit allow in it
takes precedence.

Links are read as a browser reads them, in one pass forward over a page: an attribute's value ends at its closing
quote or, without quotes, at white space or the tag's end, character references in it are decoded, comments, scripts
and other tags' values hold no links, and a relative target is resolved against the page's base, or else its URL,
whatever the scheme.
"""

from __future__ import annotations

import html as html_references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import materialise, read
from cohortlens.llm.components import connected_components

#: The contract's rules: verdict, host, path.
RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)
#: Rules stand in the plan as literals, so their number is bounded.
MAX_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)="
#: Only pages that name a link, or may do so by character references, are looked through.
NAMED, TAGGED = r"(?i)canonical|refresh", r"(?i)<(link|meta)[\s/]"
BLANK = " \t\n\f\r"
TAG_NAME = re.compile(rf"/?([a-zA-Z][^{BLANK}/>]*+)")
#: White space and slashes, then a name; then, if there is one, the sign before a value.
ATTRIBUTE_NAME, BEFORE_VALUE, UNQUOTED = re.compile(rf"[{BLANK}/]*+(=?[^{BLANK}/>=]*+)"), re.compile(rf"[{BLANK}]*+=[{BLANK}]*+"), re.compile(rf"[^{BLANK}>]*+")
COMMENT_END = re.compile(r"--!?>")
#: Elements whose content is text up to their end tag.
TEXT_ENDS = {n: re.compile(rf"</{n}(?=[{BLANK}/>])", re.I) for n in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
REFRESH = re.compile(r"""\s*[0-9.]*\s*[;,\s]\s*(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(.*))""", re.I | re.S)
#: What follows a scheme, cut into authority, path and the rest.
SCHEME, PARTS = re.compile(r"([a-zA-Z][a-zA-Z0-9+.\-]*):"), re.compile(r"([^/?#]*)([^?#]*)(.*)", re.S)


def tags_of(page: str) -> Iterator[tuple[str, dict[str, str]]]:
    """Name and attributes of each tag of a page, in one pass; a tag that is still open at the page's end is none."""
    at = page.find("<")
    while at >= 0:
        name = TAG_NAME.match(page, at + 1)
        if name is None:
            if page.startswith("<!--", at):
                end = COMMENT_END.search(page, at + 2)
                at = page.find("<", end.end()) if end else -1
            elif page.startswith(("<!", "<?", "</"), at):
                end = page.find(">", at)
                at = page.find("<", end) if end >= 0 else -1
            else:
                at = page.find("<", at + 1)
            continue
        kind, held, at = name[1].lower(), {}, name.end()
        while True:
            attribute = ATTRIBUTE_NAME.match(page, at)
            at = attribute.end()
            if at >= len(page):
                return
            if page[at] == ">" and not attribute[1]:
                break
            value = ""
            if sign := BEFORE_VALUE.match(page, at):
                at = sign.end()
                quote = page[at : at + 1]
                if quote in ("'", '"') and quote:
                    end = page.find(quote, at + 1)
                    if end < 0:
                        return
                    value, at = page[at + 1 : end], end + 1
                else:
                    plain = UNQUOTED.match(page, at)
                    value, at = plain[0], plain.end()
            held.setdefault(attribute[1].lower(), value)
        opened = page[name.start()] != "/"
        if opened:
            yield kind, held
        if opened and kind in TEXT_ENDS:
            end = TEXT_ENDS[kind].search(page, at)
            at = end.start() if end else -1
        else:
            at = page.find("<", at)


def links_of(url: str, page: str) -> list[str]:
    """The absolute URLs of all canonical links and refreshes of a page, in their order."""
    base, found = url, []
    for kind, held in tags_of(page):
        if kind not in ("link", "meta", "base"):
            continue
        value = lambda n: html_references.unescape(held.get(n, "")).strip()  # noqa: B023, E731
        if kind == "base":
            base = resolve(url, value("href")) or url if value("href") and base == url else base
        elif kind == "link" and "canonical" in value("rel").lower().split():
            found.append(value("href"))
        elif kind == "meta" and value("http-equiv").lower() == "refresh" and (target := REFRESH.match(value("content"))):
            found.append(next(filter(None, target.groups()), "").strip())
    return [x for link in found if link and (x := resolve(base, link))]


def resolve(base: str, link: str) -> str:
    """The absolute URL of a link on a page at base, whatever its scheme; empty if base has no ://."""
    link = re.sub(r"[\t\r\n]", "", link)
    own, (scheme, mark, rest) = SCHEME.match(link), base.partition("://")
    if own and not (mark and own[1].lower() == scheme.lower() and not link.startswith("//", own.end())):
        return link
    link = link[own.end() :] if own else link
    authority, path, _ = PARTS.match(rest).groups()
    if not mark or ("[" in authority) != ("]" in authority):
        return ""
    if link.startswith("//"):
        return f"{scheme}:{link}"
    if link.startswith("#"):
        return base.partition("#")[0] + link
    if link.startswith("?"):
        return f"{scheme}://{authority}{path}{link}"
    to, tail = re.match(r"([^?#]*)(.*)", link, re.S).groups()
    steps: list[str] = []
    parts = (to if to.startswith("/") else (path.rpartition("/")[0] + "/" + to)).split("/")[1:]
    for step in parts:
        if step == "..":
            del steps[-1:]
        elif step != ".":
            steps.append(step)
    if parts and parts[-1] in ("..", "."):
        steps.append("")
    return f"{scheme}://{authority}/{'/'.join(steps)}{tail}"


def page_links(pages: DataFrame) -> DataFrame:
    """url and target of each link of pages (url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, targets = [], []
            for k in range(len(batch)):
                url = batch.column(0)[k].as_py()
                found = links_of(url, batch.column(1)[k].as_py())
                urls += [url] * len(found)
                targets += found
            yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(targets, pa.string())], names=["url", "target"])

    named = F.col("html").rlike(NAMED) | (F.col("html").contains("&") & F.col("html").rlike(TAGGED))
    return pages.where(F.col("url").isNotNull() & named).select("url", "html").mapInArrow(run, "url string, target string")


def _rest(url: Column) -> Column:
    """What follows the first ://; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The canonical URL without its scheme; null without a host."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(/index)?\.html?\z", ""), r"/+\z", "")
    query = F.split(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(query, lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def best_rule(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule as a struct (size, allow, rule); null if none fits. At equal length allow wins."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(v == "allow").alias("allow"), F.lit(h + p).alias("rule")),
        )
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,allow:boolean,rule:string>")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) of each row of pages (page_id, url, html).

    A null url or one without :// has an empty host and path, no rule and no alias, and is allowed; a null or empty
    html has no links; a very long one is looked through as a whole. Repeated rows give repeated rows; at equal
    length of two rules allow wins; other columns are not read; an empty table gives an empty result.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # The rows that matter from here on hold no html: links are taken out while it is read.
    links_out = materialise(
        page_links(page).select(canonical(F.col("url")).alias("a"), "target", canonical(F.col("target")).alias("b")).where("a is not null and b is not null").distinct(), "links"
    )
    parts = page.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("node"))
    ruled = parts.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))

    component = connected_components(links_out.select("a", "b"), "aliases")
    targets = links_out.select("target", F.col("b").alias("node")).withColumn("best", best_rule(host_of(F.col("target")), path_of(F.col("target")), rules))
    seeds = ruled.select("node", "best").unionByName(targets.select("node", "best")).where("node is not null and best is not null")
    by_node = seeds.groupBy("node").agg(F.max("best.allow").alias("allowed"))
    nodes = by_node.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spread = nodes.groupBy("component").agg(F.max("allowed").alias("allowed")).where("not allowed").select("component")
    # Blocked nodes: those of a blocked component, met by a page through its node's component or directly.
    blocked = materialise(
        component.join(spread, "component", "left_semi").select("node").unionByName(spread.select(F.col("component").alias("node"))).distinct(), "blocked"
    )
    own = ruled.where("best is not null or node is null").select("page_id", "host", "path", "best.rule", F.when(F.col("best.allow"), "allow").when(~F.col("best.allow"), "block").otherwise("allow").alias("verdict"))
    rest = ruled.where("best is null and node is not null").join(blocked.withColumn("hit", F.lit(True)).hint("merge"), "node", "left")  # as many as there are pages: never broadcast
    return own.unionByName(rest.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("hit"), "block").otherwise("allow").alias("verdict")))


def op8_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


def planted(pages: DataFrame) -> DataFrame:
    """page_id, url and html of pages, where html is made of links: what a query with aliases is compared on.

    By page_id modulo 7: a canonical link to the next page's URL; one with character references; one relative to
    the host; two canonical links, the first empty; a refresh; one relative to the path; none.
    """
    n = F.pmod("page_id", F.lit(7))
    number = (F.col("page_id") + 1).cast("string")
    url = F.concat(F.lit("http://h"), (F.floor(F.col("page_id") / 21)).cast("string"), F.lit(".io/a/"), F.col("page_id").cast("string"))
    target = F.concat(F.lit("http://h"), (F.floor((F.col("page_id") + 1) / 21)).cast("string"), F.lit(".io/a/"), number)
    html = (
        F.when(n == 0, F.concat(F.lit('<link rel="canonical" href="'), target, F.lit('">')))
        .when(n == 1, F.concat(F.lit("<link rel=canonical href='"), target, F.lit("?ref=1&amp;utm_source=2'>")))
        .when(n == 2, F.concat(F.lit('<link href="/a/'), number, F.lit('" rel="canonical">')))
        .when(n == 3, F.concat(F.lit('<link rel="canonical" href=""><link rel="canonical" href="'), F.when(F.col("url").contains("://"), F.col("url")).otherwise(""), F.lit('">')))
        .when(n == 4, F.concat(F.lit('<meta http-equiv="refresh" content="0; url='), target, F.lit('#x">')))
        .when(n == 5, F.concat(F.lit('<link rel="canonical" href="../a/'), number, F.lit('">')))
    )
    return pages.select("page_id", url.alias("url"), F.coalesce(html, F.lit("<p>no link")).alias("html"))


def redirects_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator on pages with planted links, so that components have something to do."""
    return judge(planted(read(spark, sf_dir, "pages")))


def chained(pages: DataFrame) -> DataFrame:
    """page_id, url and html of pages whose links make long chains, hubs and cycles, in blocks of 41 pages.

    By the block's number modulo 3: each page names the next one, up to the block's last; all name its first one; each
    names the next one and the last names the first. The eighth page also names its own URL in the table, if that has a
    scheme, so that a block has rules to take from there.
    """
    block, place = F.floor(F.col("page_id") / 41), F.pmod("page_id", F.lit(41))
    at = lambda n: F.concat(F.lit("app://c"), block.cast("string"), F.lit(".io/p/"), n.cast("string"))
    link = lambda to: F.concat(F.lit("<p a=\"<\">x</p><link data-x=it's rel=\"can&#111;nical\" href='"), to, F.lit("'>"))
    kind = F.pmod(block, F.lit(3))
    next_ = F.when(kind == 1, link(F.lit("0"))).when(place < 40, link((place + 1).cast("string"))).when(kind == 2, link(F.lit("/p/0"))).otherwise("<p>last")
    own = F.when((place == 7) & F.col("url").contains("://"), link(F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("'"), F.lit("&#39;")))).otherwise("")
    return pages.select("page_id", at(place).alias("url"), F.concat(next_, own).alias("html"))


def redirects_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator on chains of 41 pages, hubs and cycles."""
    return judge(chained(read(spark, sf_dir, "pages")))


def _sql(pages: str) -> str:
    rest = lambda u: f"case when strpos({u}, '://') > 0 then substr({u}, strpos({u}, '://') + 3) end"
    host = lambda u: f"coalesce(translate(regexp_extract({rest(u)}, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '')"
    path = lambda u: f"coalesce(regexp_extract({rest(u)}, '^[^/?#]*([^?#]*)', 1), '')"

    def node(u: str) -> str:
        bare = rf"regexp_replace({host(u)}, '^(www|m)\.', '')"
        short = rf"regexp_replace(regexp_replace({path(u)}, '(/index)?\.html?\z', ''), '/+\z', '')"
        kept = rf"array_to_string(list_sort(list_filter(string_split(regexp_extract({rest(u)}, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '{TRACKING}'))), '&')"
        return f"case when {bare} <> '' then {bare} || {short} || case when {kept} <> '' then '?' || {kept} else '' end end"

    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    best = lambda t: f"(select arg_max(struct_pack(v := v, r := h || p), length(h || p)) from rules where ({t}.host = h or ends_with({t}.host, '.' || h)) and starts_with({t}.path, p))"
    # Tags are the pieces between < and >; quotes around a value are taken off, the commonest references decoded, and
    # the steps .. and . of a relative path folded from the left.
    dots = "list_reduce(list_prepend([]::varchar[], list_transform(string_split({p}, '/'), lambda x: [x])), lambda acc, x: case when x[1] = '..' then acc[:len(acc) - 1] when x[1] = '.' then acc else list_concat(acc, x) end)"
    return rf"""
with recursive rules(v, h, p) as (values {values}),
src as ({pages}),
page as (select page_id, url, {host('url')} as host, {path('url')} as path, {node('url')} as node from src),
tag as (select url, split_part(piece, '>', 1) as tag from (select url, unnest(string_split(html, '<')) as piece from src where html is not null and url is not null)),
raw as (
  select url, coalesce(nullif(regexp_extract(tag, '(?i)\shref="([^"]*)"', 1), ''), nullif(regexp_extract(tag, '(?i)\shref=''([^'']*)''', 1), ''), regexp_extract(tag, '(?i)\shref=([^\s"'']+)', 1)) as link
  from tag where tag ilike 'link %' and regexp_matches(replace(tag, '&#111;', 'o'), '(?i)rel=["'']?canonical')
  union all select url, regexp_extract(regexp_extract(tag, '(?i)content=["'']([^"'']*)', 1), '(?i)url=(.*)', 1) from tag where tag ilike 'meta %' and tag ilike '%refresh%'),
link_text as (select url, replace(replace(replace(replace(link, '&quot;', '"'), '&#38;', '&'), '&#39;', ''''), '&amp;', '&') as l from raw where link <> ''),
joined as (
  select url, case when contains(l, '://') then l when starts_with(l, '//') then split_part(url, '://', 1) || ':' || l
    when starts_with(l, '/') then regexp_extract(url, '^[^:]*://[^/?#]*', 0) || l
    when starts_with(l, '?') then regexp_extract(url, '^[^?#]*', 0) || l
    else regexp_extract(url, '^[^:]*://[^/?#]*', 0) || array_to_string({dots.format(p="regexp_extract(regexp_extract(url, '^[^?#]*', 0), '^[^:]*://[^/]*(.*/)', 1) || l")}, '/') end as target from link_text),
resolved as (select {node('url')} as a, target from joined),
link as (select distinct a, target, {node('target')} as b from resolved),
edge as (select a, b from link where a is not null and b is not null union select b, a from link where a is not null and b is not null),
reach(a, b) as (select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a),
target as (select b as node, {host('target')} as host, {path('target')} as path from link where a is not null and b is not null),
ruled as (select *, {best('page')} as best from page),
seed as (select node, best.v as v from ruled where best is not null union select node, best.v from (select node, {best('target')} as best from target) where best is not null),
met as (select node, v from seed union select reach.a, seed.v from reach join seed on reach.b = seed.node),
verdicts as (select node, case when bool_or(v = 'allow') then 'allow' else 'block' end as v from met where node is not null group by node)
select page_id, host, path, best.r as rule, coalesce(best.v, verdicts.v, 'allow') as verdict from ruled left join verdicts on ruled.node = verdicts.node
"""


SQL = _sql("select page_id, url, html from pages")
PLANTED_SQL = _sql("""
select page_id, 'http://h' || page_id // 21 || '.io/a/' || page_id as url, case page_id % 7
  when 0 then '<link rel="canonical" href="' || t || '">' when 1 then '<link rel=canonical href=''' || t || '?ref=1&amp;utm_source=2''>'
  when 2 then '<link href="/a/' || page_id + 1 || '" rel="canonical">'
  when 3 then '<link rel="canonical" href=""><link rel="canonical" href="' || case when contains(url, '://') then url else '' end || '">'
  when 4 then '<meta http-equiv="refresh" content="0; url=' || t || '#x">'
  when 5 then '<link rel="canonical" href="../a/' || page_id + 1 || '">' else '<p>no link' end as html
from (select *, 'http://h' || (page_id + 1) // 21 || '.io/a/' || (page_id + 1) as t from pages)""")
CHAINED_SQL = _sql("""
select page_id, 'app://c' || page_id // 41 || '.io/p/' || page_id % 41 as url,
  case when page_id // 41 % 3 = 1 then l || '0' || e when page_id % 41 < 40 then l || (page_id % 41 + 1) || e when page_id // 41 % 3 = 2 then l || '/p/0' || e else '<p>last' end
  || case when page_id % 41 = 7 and contains(url, '://') then l || replace(replace(url, '&', '&amp;'), '''', '&#39;') || e else '' end as html
from pages, (values ('<p a="<">x</p><link data-x=it''s rel="can&#111;nical" href=''', '''>')) v(l, e)""")
