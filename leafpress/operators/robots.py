"""robots.txt rules for the agent '*', and the allowed test.

One stored robots.txt per origin: ``(origin, status, text)``.  Status 401 and 403
deny everything, other 4xx allow everything, 5xx deny everything (nothing could
be parsed), and an origin without a row is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress.functions import urls as U
from leafpress.functions.arrays import let, scan
from leafpress.operators.skew import skew_join

_SEEN_AGENT, _SEEN_RULE = 1, 2


def _line(raw: Column) -> Column:
    def build(text: Column) -> Column:
        key = F.lower(F.trim(F.regexp_extract(text, r"^([^:]*):", 1)))
        value = U.percent_decode(F.trim(F.regexp_extract(text, r"^[^:]*:(.*)$", 1)))
        kind = (
            F.when(raw == "", F.lit("blank"))
            .when(key == "user-agent", F.lit("agent"))
            .when(key.isin("allow", "disallow"), key)
            .when(key.isin("crawl-delay", "request-rate"), F.lit("pace"))
            .otherwise(F.lit("none"))
        )
        # as the standard parser has it, an empty query of a path goes
        bare = F.when(kind.isin("allow", "disallow") & (F.instr(value, "?") == F.length(value)), F.rtrim(value, F.lit("?")))
        return F.struct(kind.alias("kind"), F.coalesce(bare, value).alias("value"))

    return let(F.trim(F.regexp_replace(raw, "#.*$", "")), build)


def _step(state: Column, line: Column) -> Column:
    kind, at, group, star = line["kind"], state["at"], state["group"], state["star"]
    fresh_group = ((kind == "blank") & (at > 0)) | ((kind == "agent") & (at == _SEEN_RULE))
    is_rule = kind.isin("allow", "disallow", "pace")
    new_at = (
        F.when((kind == "blank") & (at > 0), 0)
        .when(kind == "agent", _SEEN_AGENT)
        .when(is_rule & (at > 0), _SEEN_RULE)
        .otherwise(at)
    )
    kept_star = star & ~fresh_group
    new_star = kept_star | ((kind == "agent") & line["value"].isin("*", ""))
    return F.struct(
        new_at.alias("at"),
        F.when(fresh_group, group + 1).otherwise(group).alias("group"),
        new_star.alias("star"),
    )


def star_rules(text: Column) -> Column:
    """Rules of the first group for '*', in file order: array of (path, allow)."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("group"), F.lit(False).alias("star"))

    def emit(s: Column) -> Column:
        # group number, or -1 where no rule for '*' can stand
        return F.when((s["at"] == _SEEN_RULE) & s["star"], s["group"]).otherwise(F.lit(-1))

    def rules(lines: Column) -> Column:
        return let(scan(lines, zero, _step, emit), lambda groups: pick(lines, groups))

    def pick(lines: Column, groups: Column) -> Column:
        placed = F.transform(lines, lambda x, i: F.struct(x.alias("x"), F.get(groups, i).alias("g")))
        useful = F.filter(placed, lambda p: (p["g"] >= 0) & p["x"]["kind"].isin("allow", "disallow", "pace"))

        def first_group(u: Column) -> Column:
            chosen = F.filter(u, lambda p: (p["g"] == F.get(u, 0)["g"]) & (p["x"]["kind"] != "pace"))
            return F.transform(
                chosen,
                lambda p: F.struct(
                    p["x"]["value"].alias("path"),
                    ((p["x"]["kind"] == "allow") | (p["x"]["value"] == "")).alias("allow"),
                ),
            )

        return let(useful, first_group)

    return let(F.transform(F.split(text, r"\r\n|\r|\n", -1), _line), rules)


def rules_table(robots: DataFrame) -> DataFrame:
    """``(origin, verdict, rules)``; a verdict of NULL means the rules decide."""
    code = F.col("status")
    verdict = (
        F.when(code.isin(401, 403), F.lit(False)).when(code.between(400, 499), F.lit(True)).when(code >= 500, F.lit(False))
    )
    return robots.select("origin", verdict.alias("verdict"), star_rules(F.coalesce("text", F.lit(""))).alias("rules"))


def rule_lines(robots: DataFrame) -> DataFrame:
    """The rules as rows ``(origin, pos, path, allow)``."""
    return rules_table(robots).select("origin", F.posexplode("rules").alias("pos", "r")).select("origin", "pos", "r.path", "r.allow")


def _target(url: Column) -> Column:
    rest = F.regexp_replace(U.percent_decode(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    return F.when(rest == "", F.lit("/")).otherwise(rest)


def with_permission(urls: DataFrame, robots: DataFrame, url: str = "url") -> DataFrame:
    """Add ``allowed``: the first rule whose path starts the target decides."""
    keyed = urls.withColumn("origin", U.origin(F.col(url))).withColumn("_target", _target(F.col(url)))
    joined = skew_join(keyed, rules_table(robots), ["origin"], "left")
    first = F.get(F.filter("rules", lambda r: F.col("_target").startswith(r["path"])), F.lit(0))
    return joined.withColumn("allowed", F.coalesce(F.col("verdict"), first["allow"], F.lit(True))).drop(
        "origin", "_target", "verdict", "rules"
    )


def allowed_only(urls: DataFrame, robots: DataFrame, url: str = "url") -> DataFrame:
    return with_permission(urls, robots, url).filter("allowed").drop("allowed")
