"""Web corpora: addresses, scopes, robots rules, link lists and curation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import col, folder_title, normalize_space
from quillspan.operators.fixpoint import cut

#: Agents of text-collecting services whose groups also apply.
AI_AGENTS = ("gptbot", "chatgpt-user", "claudebot", "claude-user", "anthropic-ai", "google-extended", "ccbot", "perplexitybot", "perplexity-user", "applebot-extended", "meta-externalagent", "bytespider", "cohere-ai")


def _dots(path: Column) -> Column:
    """A path with dot segments resolved."""
    empty = F.expr("cast(array() as array<string>)")
    parts = F.split(path, "/")
    walked = F.aggregate(parts, empty, lambda acc, p: F.when(p == ".", acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == "", acc).otherwise(F.concat(acc, F.array(p))))
    tail = F.when(path.rlike(r"(/|/\.|/\.\.)$") & (F.size(walked) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(walked, "/"), tail)


def absolute_url(href: Column | str, base: Column | str) -> Column:
    """Absolute http(s) address without its hash, else null."""
    h, b = F.regexp_replace(F.trim(col(href)), "#.*$", ""), F.regexp_replace(col(base), "[?#].*$", "")
    origin = F.lower(F.regexp_extract(b, r"^([a-zA-Z]+://[^/]+)", 1))
    base_path = F.regexp_replace(b, r"^[a-zA-Z]+://[^/]+", "")
    path, query = F.regexp_replace(h, r"\?.*$", ""), F.regexp_extract(h, r"(\?.*)$", 1)
    full = F.regexp_extract(h, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    own = F.concat(F.lower(F.regexp_extract(path, r"^([a-zA-Z]+://[^/]+)", 1)), _dots(F.regexp_replace(path, r"^[a-zA-Z]+://[^/]+", "")), query)
    out = (
        F.when(F.lower(full).isin("http", "https"), own)
        .when(full != "", F.lit(None).cast("string"))
        .when(h.startswith("//"), F.concat(F.regexp_extract(b, "^([a-zA-Z]+:)", 1), F.lower(F.regexp_extract(path, "^(//[^/]+)", 1)), _dots(F.regexp_replace(path, "^//[^/]+", "")), query))
        .when(h.startswith("/"), F.concat(origin, _dots(path), query))
        .when(path == "", F.concat(origin, _dots(base_path), query))
        .otherwise(F.concat(origin, _dots(F.concat(F.regexp_replace(base_path, "[^/]*$", ""), F.lit("/"), path)), query))
    )
    return F.when(origin.rlike("^https?://"), out)


def in_scope(url: Column | str, scope: Column | str) -> Column:
    """Whether an address without hash and query lies in the scope, or is the scope without its last slash."""
    a = F.regexp_replace(col(url), "[?#].*$", "")
    return a.startswith(col(scope)) | (F.concat(a, F.lit("/")) == col(scope))


def scope_of(starts: DataFrame, pages: DataFrame) -> DataFrame:
    """(start, scope): the start's folder; its own folder if a page is in it, else the folder it lies in."""
    s = starts.select("start", F.regexp_replace("start", "[?#].*$", "").alias("u"))
    origin = F.regexp_extract("u", r"^([a-zA-Z]+://[^/]+)", 1)
    path = F.when(F.regexp_replace("u", r"^[a-zA-Z]+://[^/]+", "") == "", "/").otherwise(F.regexp_replace("u", r"^[a-zA-Z]+://[^/]+", ""))
    s = s.select("start", origin.alias("origin"), path.alias("path"), F.concat(origin, path, F.lit("/")).alias("own"))
    p = pages.select("url", F.regexp_extract("url", r"^([a-zA-Z]+://[^/]+)", 1).alias("origin"))
    inside = s.join(p, "origin").where(F.col("url").startswith(F.col("own"))).select("start").distinct().withColumn("_in", F.lit(True))
    scope = F.when(F.col("path").endswith("/"), F.concat("origin", "path")).when(F.col("_in"), F.col("own")).otherwise(F.concat("origin", F.regexp_replace("path", "[^/]*$", "")))
    return s.join(inside, "start", "left").select("start", scope.alias("scope"))


def llms_urls(starts: DataFrame) -> DataFrame:
    """(start, rank, url): places of llms.txt, from the deepest folder of the start address to the root."""
    u = F.regexp_replace("start", "[?#].*$", "")
    origin, path = F.regexp_extract(u, r"^([a-zA-Z]+://[^/]+)", 1), F.regexp_replace(u, r"^[a-zA-Z]+://[^/]+", "")
    path = F.when(path == "", "/").otherwise(path)
    parts = F.filter(F.split(F.regexp_replace(path, "[^/]*$", ""), "/"), lambda p: p != "")
    own = F.when(~path.endswith("/") & ~F.lower(path).rlike(r"\.[a-z0-9]+$"), F.array(F.concat(path, F.lit("/")))).otherwise(F.expr("cast(array() as array<string>)"))
    folders = F.transform(F.sequence(F.size(parts), F.lit(0)), lambda k: F.when(k == 0, "/").otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), F.greatest(k, F.lit(1))), "/"), F.lit("/"))))
    return starts.select("start", F.posexplode(F.concat(own, folders)).alias("rank", "folder"), origin.alias("origin")).select("start", F.col("rank").cast("long").alias("rank"), F.concat("origin", "folder", F.lit("llms.txt")).alias("url"))


def robots_rules(lines: DataFrame, agent: str) -> DataFrame:
    """(host, grp, allow, pattern) from robots lines (host, pos, line): the agent's own groups only, else those for "*" and each text-collecting agent; an empty pattern stands for a set without rules."""
    text = F.trim(F.regexp_replace("line", "#.*$", ""))
    f, v = F.lower(F.trim(F.substring_index(text, ":", 1))), F.trim(F.regexp_replace(text, "^[^:]*:", ""))
    rows = lines.select("host", "pos", f.alias("f"), v.alias("v"), text.contains(":").alias("ok")).where("ok and f in ('user-agent', 'allow', 'disallow')")
    w = Window.partitionBy("host").orderBy("pos")
    new = (F.col("f") == "user-agent") & (F.coalesce(F.lag("f").over(w), F.lit("")) != "user-agent")
    rows = rows.withColumn("_n", new.cast("int")).withColumn("grp_no", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("grp_no > 0")
    agents = rows.where("f = 'user-agent'").select("host", "grp_no", F.lower("v").alias("grp")).distinct()
    rules = rows.where("f <> 'user-agent' and v <> ''").select("host", "grp_no", (F.col("f") == "allow").alias("allow"), F.col("v").alias("pattern"))
    mine = agents.where(F.col("grp") == agent).select("host").distinct().withColumn("_mine", F.lit(True))
    every = agents.join(mine, "host", "left").where(F.when(F.col("_mine"), F.col("grp") == agent).otherwise(F.col("grp").isin("*", *AI_AGENTS)))
    return every.select("host", "grp_no", "grp").join(rules, ["host", "grp_no"]).select("host", "grp", "allow", "pattern")


def rule_pattern(pattern: Column) -> Column:
    """A robots pattern as a regular expression: * is any text, a last $ the end."""
    body = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(body, F.lit("*"), F.lit(".*")), F.when(pattern.endswith("$"), "$").otherwise(""))


def robots_allow(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, allowed): in each set of rules the longest match wins, Allow on a tie; every set must allow; no match allows."""
    hit = urls.join(rules, "host").where(F.regexp_like("path", rule_pattern(F.col("pattern"))))
    per = hit.groupBy("host", "path", "grp").agg(F.max_by("allow", F.struct(F.length("pattern"), "allow")).alias("a")).groupBy("host", "path").agg(F.bool_and("a").alias("a"))
    return urls.select("host", "path").distinct().join(per, ["host", "path"], "left").select("host", "path", F.coalesce("a", F.lit(True)).alias("allowed"))


def llms_chapters(lines: DataFrame, scope: str) -> DataFrame:
    """(site, chapter, pos, title, url) from llms.txt lines: in-scope list links, first-seen address wins; with several "##" groups these are the chapters, else the folders below the scope."""
    w = Window.partitionBy("site").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    group = F.last(F.when(F.col("line").rlike(r"^##\s+"), F.trim(F.regexp_replace("line", r"^##\s+", ""))), True).over(w)
    link = r"^\s*[-*+]\s*\[([^\]]+)\]\((\S+?)\)"
    rows = lines.withColumns({"grp": group, "title": normalize_space(F.regexp_extract("line", link, 1)), "url": F.regexp_replace(F.regexp_extract("line", link, 2), "#.*$", "")}).where("url <> ''").where(in_scope("url", F.lit(scope)))
    first = F.row_number().over(Window.partitionBy("site", "url").orderBy("pos"))
    rows = rows.withColumn("_r", first).where("_r = 1")
    groups = rows.groupBy("site").agg(F.countDistinct("grp").alias("n"))
    rest = F.substr(F.regexp_replace("url", "[?].*$", ""), F.lit(len(scope) + 1))
    folder = F.when(rest.contains("/"), folder_title(F.substring_index(rest, "/", 1))).otherwise(F.col("title"))
    return rows.join(groups, "site").select("site", F.when(F.col("n") > 1, F.col("grp")).otherwise(folder).alias("chapter"), "pos", "title", "url")


def skip_report(pages: DataFrame, reasons: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """(key, reason): the first reason in the given order of every page that has one."""
    out = None
    for k, (name, bad) in enumerate(reasons):
        one = pages.join(bad.select(key).distinct(), key, "left_semi").select(key, F.lit(k).alias("_k"), F.lit(name).alias("reason"))
        out = one if out is None else out.unionAll(one)
    return out.groupBy(key).agg(F.min_by("reason", "_k").alias("reason"))


def resolve_redirects(log: DataFrame, hops: int = 5) -> DataFrame:
    """(url, final, n, problem) on a crawl log (url, status, location): at most ``hops`` hops over http(s), without fragments."""
    step = log.where("status between 300 and 399 and location is not null").select(F.col("url").alias("_u"), absolute_url("location", "url").alias("_to"))
    now = log.select("url", F.col("url").alias("final"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("problem"))
    for _ in range(hops + 1):
        j = now.join(step, (F.col("final") == F.col("_u")) & F.col("problem").isNull(), "left")
        moved = F.col("_u").isNotNull()
        bad = moved & F.col("_to").isNull()
        far = moved & (F.col("n") >= hops)
        now = cut(
            j.select("url", F.when(moved & ~bad & ~far, F.col("_to")).otherwise(F.col("final")).alias("final"), (F.col("n") + (moved & ~bad & ~far).cast("long")).alias("n"), F.coalesce("problem", F.when(bad, "not http"), F.when(far, "too many redirects")).alias("problem")),
            "hops",
        )
    return now


def apply_toc_picks(items: DataFrame, picks: DataFrame) -> DataFrame:
    """(chapter, number, url): picked items by number, each page once (its first pick); chapters without a page are gone."""
    got = picks.join(items.where("url is not null"), "number")
    first = F.row_number().over(Window.partitionBy("url").orderBy("chapter", "number"))
    return got.withColumn("_r", first).where("_r = 1").select("chapter", "number", "url")


def check_toc(toc: DataFrame, scope: str) -> DataFrame:
    """(url, problem) of rows that are not http(s), not of the scope's origin, or outside the scope."""
    origin = scope.split("/", 3)[:3]
    host = "/".join(origin)
    problem = F.when(~F.col("url").rlike("^https?://"), "not http").when(~F.col("url").startswith(host), "other site").when(~in_scope("url", F.lit(scope)), "out of scope")
    return toc.select("url", problem.alias("problem")).where("problem is not null")
