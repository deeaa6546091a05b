"""URL filtering by rules and by trust and distrust that spread over host links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.session import stage_once

DAMPING = 0.85
#: Rounds that OP9_SQL unrolls; the operator itself goes on until the scores have settled.
ROUNDS = 12
#: Scores have settled when a round changes their sum (of 1 trust and 1 distrust) by no more than this.
TOLERANCE = 1e-6
#: Rounds planned as one job between tables; after each the changes of one more round are summed.
TOGETHER = 7
#: A host without a rule is blocked if its share of distrust among trust and distrust is over this.
BLOCK_OVER = 0.5
#: Absolute and protocol-relative links; group 1 is the host. Relative links stay on their host.
LINK = r"""[Hh][Rr][Ee][Ff]\s*=\s*["']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'<>\s]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return lower_ascii(F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Index of the longest rule for the host, or a domain above it, and the start of the path; NULL if none fits."""
    out = F.lit(None).cast("int")
    for i, rule in sorted(enumerate(rules), key=lambda r: len(r[1].text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts.

    Hyperlinks count once per page and target. A host and the domain right above it (of two labels or more)
    are linked both ways, with the weight of the host's pages: one owner runs both.
    """
    linked = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("to"))
    linked = linked.select(F.col("host").alias("src"), lower_ascii(F.col("to")).alias("dst"))
    counted = linked.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    above = F.when(F.size(F.split("host", r"\.")) > 2, F.expr("substring(host, instr(host, '.') + 1)"))
    steps = hosts.select(F.col("host").alias("src"), above.alias("dst"), "n").filter("dst IS NOT NULL")
    both = steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    return counted.unionByName(both).filter("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def spread(
    links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE,
) -> DataFrame:
    """(host, trust, distrust): personalised PageRank from seeds, along links and against them.

    ``seeds`` has ``host``, ``trust`` and ``distrust``, each summing to 1 (or all 0). Trust follows links;
    distrust goes back from a host to those that link to it. A host shares its score by link weights; the
    part of hosts without links returns to the seeds by the restart of the next round only. Scores
    are written to the shared folder every few rounds.

    Without ``rounds`` the iteration ends with a round that reaches no further host and whose changes sum to
    ``tolerance`` at most; all later rounds together then move at most damping / (1 - damping) times as much,
    and every host with a way to a seed has its score, however long the way (up to some thousand links, where
    doubles end).
    """
    out = links.groupBy("src").agg(F.sum("n").alias("total"))
    back = links.groupBy("dst").agg(F.sum("n").alias("total"))
    forward = links.join(out, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("total")).alias("trust"), F.lit(0.0).alias("distrust"))
    reverse = links.join(back, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("trust"), (F.col("n") / F.col("total")).alias("distrust"))
    edges = stage_once(forward.unionByName(reverse).groupBy("host", "to").agg(F.sum("trust").alias("part_t"), F.sum("distrust").alias("part_d")), "host-links")
    seeds = stage_once(seeds.select("host", "trust", "distrust"), "seeds")
    restart = seeds.select("host", ((1 - damping) * F.col("trust")).alias("trust"), ((1 - damping) * F.col("distrust")).alias("distrust"))
    none = F.lit(0.0)

    def moved(scores: DataFrame) -> DataFrame:
        steps = scores.join(edges, "host").select(
            F.col("to").alias("host"), (damping * F.col("trust") * F.col("part_t")).alias("trust"), (damping * F.col("distrust") * F.col("part_d")).alias("distrust"),
        )
        return steps.unionByName(restart)

    def after(scores: DataFrame, rounds: int) -> DataFrame:
        for _ in range(rounds):
            scores = moved(scores).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        return stage_once(scores, "scores")

    scores = seeds
    if rounds is not None:
        for done in range(0, rounds, TOGETHER):
            scores = after(scores, min(TOGETHER, rounds - done))
        return scores
    while True:
        scores = after(scores, TOGETHER)
        new = moved(scores).withColumns({"was_t": none, "was_d": none})
        old = scores.select("host", none.alias("trust"), none.alias("distrust"), F.col("trust").alias("was_t"), F.col("distrust").alias("was_d"))
        both = new.unionByName(old).groupBy("host").agg(*[F.sum(c).alias(c) for c in ("trust", "distrust", "was_t", "was_d")])
        scores = stage_once(both, "scores")
        step = scores.agg(
            F.sum(F.abs(F.col("trust") - F.col("was_t")) + F.abs(F.col("distrust") - F.col("was_d"))).alias("change"),
            F.max(((F.col("trust") > 0) & (F.col("was_t") == 0)) | ((F.col("distrust") > 0) & (F.col("was_d") == 0))).alias("further"),
        ).first()
        scores = scores.select("host", "trust", "distrust")
        if not step.further and (step.change or 0.0) <= tolerance:
            return scores


def judge_urls(
    pages: DataFrame, rules: list[Rule], damping: float = DAMPING, rounds: int | None = None, block_over: float = BLOCK_OVER,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages`` (``page_id``, ``url``, ``html``).

    The longest fitting rule decides. Hosts with allowed pages are trusted seeds and hosts with blocked pages
    blocked seeds, by their numbers of such pages; where no rule fits, a host is blocked if distrust is over
    ``block_over`` of the trust and distrust that reach it, and allowed otherwise, also if neither reaches it.
    ``rounds`` and ``tolerance`` are those of ``spread``: by default the scores settle.

    A NULL url, or one without ``://``, has an empty host and path; empty hosts seed nothing and are allowed.
    NULL html has no links. Repeated rows repeat, and count as pages. Other columns are not read; an empty
    table gives no rows.
    """
    verdicts = F.array(*[F.lit(r.verdict) for r in rules])
    texts = F.array(*[F.lit(r.text) for r in rules])
    placed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("html"))
    ruled = placed.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    kept = F.when(F.get(verdicts, F.col("_rule")) == "allow", 1).otherwise(0)
    barred = F.when(F.get(verdicts, F.col("_rule")) == "block", 1).otherwise(0)
    counts = stage_once(
        ruled.filter("host <> ''").groupBy("host").agg(F.sum(kept).alias("allowed"), F.sum(barred).alias("blocked")), "host-pages",
    )
    total = counts.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    seeds = counts.filter("allowed + blocked > 0").select(
        "host", (F.col("allowed") / F.lit(float(total.a or 1))).alias("trust"), (F.col("blocked") / F.lit(float(total.b or 1))).alias("distrust"),
    )
    scores = spread(host_links(placed), seeds, damping, rounds, tolerance)
    share = F.col("distrust") / (F.col("trust") + F.col("distrust"))
    method = F.when(F.round(share, 9) > block_over, "block").otherwise("allow")
    scored = stage_once(scores.withColumn("method", F.when(F.col("trust") + F.col("distrust") > 0, method).otherwise("allow")), "judged")
    return ruled.drop("html").join(scored, "host", "left").select(
        "page_id", "host", "path", F.get(texts, F.col("_rule")).alias("rule"),
        F.coalesce(F.get(verdicts, F.col("_rule")), "method", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
