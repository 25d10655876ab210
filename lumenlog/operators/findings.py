"""Findings: de-duplication, lifecycle and matching against events."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import severity as sev, similarity as sim
from . import pairs
from ..storage import stored

#: Phrases by which evidence contradicts a resolution.
CONTRADICTIONS = (
    "remains unresolved", "not resolved", "still unresolved", "not been resolved", "has not been fixed", "not yet resolved", "no evidence of resolution", "no resolution", "still active", "still occurring", "still happening", "still ongoing", "still present", "still exists", "still persists",
    "persists", "unresolved", "continues to", "ongoing", "issue remains", "issue persists", "issue continues", "problem persists", "problem remains", "problem continues", "error persists", "error remains", "error continues", "no change", "no fix", "not fixed", "unchanged",
    "indicating the issue remains", "confirm ongoing", "confirms ongoing", "confirming ongoing", "failed", "failure", "connection error", "connection failure", "connection refused", "reconnection failed", "unreachable",
)
#: Severities that prove a problem, not its end.
PROBLEMS = ("error", "err", "critical", "crit", "alert", "emergency", "emerg")
SELF_OVERLAP = 0.4


def same_criterion(a: Column, b: Column) -> Column:
    """Equal, or one of them unknown."""
    return F.coalesce(a, F.lit("")).isin("") | F.coalesce(b, F.lit("")).isin("") | (a == b)


def fingerprinted(findings: DataFrame, text: str = "text") -> DataFrame:
    """Adds tokens and fingerprint, both of one normal form; a null text is empty."""
    df = findings.withColumn("tokens", sim.tokens_of(F.coalesce(text, F.lit(""))))
    return df.withColumn("fingerprint", sim.fingerprint_of("tokens"))


def candidate_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of one system's findings that share a token: those without one have similarity 0 and need no look."""
    left = a.select("system_id", F.col("id").alias("a_id"), F.explode(F.array_distinct("tokens")).alias("token"))
    right = b.select("system_id", F.col("id").alias("b_id"), F.explode(F.array_distinct("tokens")).alias("token"))
    return left.join(right, ["system_id", "token"]).groupBy("system_id", "a_id", "b_id").agg(F.count(F.lit(1)).alias("shared"))


def jaccard_pairs(a: DataFrame, b: DataFrame, threshold: float = 0.0) -> DataFrame:
    """a_id, b_id and Jaccard similarity of tokenised findings (id, system_id, tokens) of one system."""
    sizes = lambda df, side: df.select("system_id", F.col("id").alias(f"{side}_id"), F.size(F.array_distinct("tokens")).alias(f"{side}_n"))
    df = candidate_pairs(a, b).join(sizes(a, "a"), ["system_id", "a_id"]).join(sizes(b, "b"), ["system_id", "b_id"])
    return df.withColumn("jaccard", F.col("shared") / (F.col("a_n") + F.col("b_n") - F.col("shared"))).filter(F.col("jaccard") >= threshold).select("system_id", "a_id", "b_id", "jaccard")


def idf(docs: DataFrame) -> DataFrame:
    """system_id, token, idf = ln((N + 1) / (1 + df)) + 1 over tokenised findings."""
    n = docs.groupBy("system_id").agg(F.count(F.lit(1)).alias("_n"))
    df = docs.select("system_id", "id", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("system_id", "token").agg(F.count(F.lit(1)).alias("_df"))
    return df.join(n, "system_id").select("system_id", "token", (F.log((F.col("_n") + 1) / (F.col("_df") + 1)) + 1).alias("idf"))  # one row a system


def weighted(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """system_id, id, token, w: term frequency times idf; unknown terms have idf 1."""
    tf = docs.select("system_id", "id", F.size("tokens").alias("_len"), F.explode("tokens").alias("token")).groupBy("system_id", "id", "token").agg((F.count(F.lit(1)) / F.first("_len")).alias("tf"))
    return tf.join(weights, ["system_id", "token"], "left").select("system_id", "id", "token", (F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("w"))


def tfidf_similar(a: DataFrame, b: DataFrame | None, threshold: float, best: bool = False, book: np.ndarray | None = None) -> DataFrame:
    """``pairs.similar`` of tokenised findings by TF-IDF cosine over the corpus ``b`` (``a`` itself without it).

    Tasks send counts of terms, whose idf they all know; where the vocabulary is too large for that, they know that of common terms,
    and rows carry the frequencies of their rare ones. For ``best`` equal rows are compared once.
    """
    corpus = a if b is None else b
    often, sizes = pairs.frequencies(corpus, None if b is None else a), pairs.sizes_of(corpus)
    terms = [pairs.counted_terms(df) for df in (a, b) if df is not None]
    book = pairs.codebook(*terms) if book is None else book
    if best:
        (left, members), (right, _) = (pairs.classes(x, book, True) for x in terms)
    else:
        left, right = (*(stored(pairs.coded(x, book, True), "coded") for x in terms), None)[:2]
    if often.count() <= pairs.MOST_TERMS:
        idf = book, pairs.idf_table(corpus, often, sizes), sizes
    else:
        common = often.join(F.broadcast(a.sparkSession.createDataFrame(pa.table({"term": book}))), "term")  # at most CODES rows
        idf = book, pairs.idf_table(corpus, common, sizes), sizes
        left, right = (None if df is None else pairs.ranked(df, often, *idf, own) for df, own in ((left, b is None), (right, True)))
    found = pairs.similar(left, right, threshold, weighted=True, best=best, idf=idf)
    return found.withColumnRenamed("a_id", "set_id").join(members, ["system_id", "set_id"]).select("system_id", F.col("id").alias("a_id"), "b_id", "similarity") if best else found


def cosine_pairs(a: DataFrame, b: DataFrame, threshold: float = 0.0) -> DataFrame:
    """a_id, b_id and TF-IDF cosine over the corpus ``b``: a join on shared terms, summed."""
    weights = idf(b)
    wa, wb = weighted(a, weights), weighted(b, weights)
    norm = lambda df, side: df.groupBy("system_id", F.col("id").alias(f"{side}_id")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(f"{side}_norm"))
    left = wa.select("system_id", F.col("id").alias("a_id"), "token", F.col("w").alias("wa"))
    right = wb.select("system_id", F.col("id").alias("b_id"), "token", F.col("w").alias("wb"))
    dots = left.join(right, ["system_id", "token"]).groupBy("system_id", "a_id", "b_id").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    df = dots.join(norm(wa, "a"), ["system_id", "a_id"]).join(norm(wb, "b"), ["system_id", "b_id"])
    return df.withColumn("cosine", F.col("dot") / (F.col("a_norm") * F.col("b_norm"))).filter(F.col("cosine") >= threshold).select("system_id", "a_id", "b_id", "cosine")


DECISION = "system_id long, seq long, action string, open_id long, escalated string"


def candidates(new: DataFrame, opened: DataFrame, threshold: float, most: int) -> DataFrame:
    """system_id, seq, open_id, open_severity, place: the open findings a new one may be matched with, the first choice first.

    The first with its fingerprint, then its best TF-IDF match (where a system has three open findings or
    more), then those alike by Jaccard in the order of their ids. A batch takes less than ``most`` open
    findings before any of its own, so no more than that many of each kind are needed. Open findings are
    compared in blocks and as distinct token sets, never as a whole system.
    """
    keys = opened.select("system_id", F.col("id").alias("open_id"), F.col("severity").alias("open_severity"), F.col("criterion_slug").alias("open_slug"))
    n = new.select("system_id", "seq", "criterion_slug")
    fits = same_criterion(F.col("criterion_slug"), F.col("open_slug"))

    same = opened.select("system_id", "fingerprint", F.col("id").alias("open_id"), F.col("criterion_slug").alias("open_slug"))
    first = same.groupBy("system_id", "fingerprint", "open_slug").agg(F.min("open_id").alias("open_id"))
    by_print = new.select("system_id", "seq", "criterion_slug", "fingerprint").join(first, ["system_id", "fingerprint"]).filter(fits).groupBy("system_id", "seq").agg(F.min("open_id").alias("open_id")).withColumn("kind", F.lit(0))

    # Best by cosine among all open findings; equal ones (to 12 digits) go by id. Criteria are looked at afterwards.
    asked = new.select("system_id", F.col("seq").alias("id"), "tokens")
    many = opened.groupBy("system_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").select("system_id")
    own_terms, open_terms = pairs.token_terms(new.select("system_id", F.col("seq").alias("id"), "tokens"), empty_alike=True), pairs.token_terms(opened, empty_alike=True)
    book = pairs.codebook(own_terms, open_terms)
    near = tfidf_similar(asked, opened, threshold - 1e-12, best=True, book=book).select("system_id", F.col("a_id").alias("seq"), F.col("b_id").alias("open_id"), F.round("similarity", 12).alias("score"))
    best = near.filter(F.col("score") >= threshold).groupBy("system_id", "seq").agg(F.max_by("open_id", F.struct("score", -F.col("open_id"))).alias("open_id"))
    best = stored(best, "best")  # one row a new finding; what is written keeps plans small
    by_cosine = best.join(many, "system_id", "left_semi").join(n, ["system_id", "seq"]).join(keys, ["system_id", "open_id"]).filter(fits).select("system_id", "seq", "open_id", F.lit(1).alias("kind"))

    own_sets, own = pairs.classes(own_terms, book)
    open_sets, members = pairs.classes(open_terms, book)
    alike = stored(pairs.similar(own_sets, open_sets, threshold).select("system_id", F.col("a_id").alias("own_set"), F.col("b_id").alias("open_set")), "alike")
    early = members.select("system_id", F.col("set_id").alias("open_set"), F.col("id").alias("open_id")).join(keys.select("system_id", "open_id", "open_slug"), ["system_id", "open_id"])
    early = early.withColumn("at", F.row_number().over(W.partitionBy("system_id", "open_set", "open_slug").orderBy("open_id"))).filter(F.col("at") <= most).drop("at")
    met = own.select("system_id", F.col("set_id").alias("own_set"), F.col("id").alias("seq")).join(n, ["system_id", "seq"]).join(alike, ["system_id", "own_set"]).join(early, ["system_id", "open_set"]).filter(fits)
    by_words = met.withColumn("at", F.row_number().over(W.partitionBy("system_id", "seq").orderBy("open_id"))).filter(F.col("at") <= most).select("system_id", "seq", "open_id", F.lit(2).alias("kind"))

    found = by_print.select("system_id", "seq", "open_id", "kind").unionByName(by_cosine).unionByName(by_words)
    return found.join(keys.select("system_id", "open_id", "open_severity"), ["system_id", "open_id"]).groupBy("system_id", "seq").agg(F.array_sort(F.collect_list(F.struct("kind", "open_id", "open_severity"))).alias("choices"))


def decided(key: tuple, batch: pd.DataFrame, threshold: float, most_new: int) -> pd.DataFrame:
    """The decisions of one batch, in the order of seq; its rows carry their tokens and their choices among open findings."""
    rank = lambda s: sev.FINDING_RANKS.get(s, 1)
    fit = lambda x, y: not x or not y or x == y

    def alike(x: frozenset, y: frozenset) -> float:
        return 1.0 if not x and not y else len(x & y) / len(x | y)

    out, kept = [], []
    for r in sorted(batch.to_dict("records"), key=lambda r: r["seq"]):
        r["words"] = frozenset(() if r["tokens"] is None else r["tokens"])
        at = next((i for i, k in enumerate(kept) if fit(r["criterion_slug"], k["criterion_slug"]) and alike(r["words"], k["words"]) >= threshold), None)
        if at is None:
            kept.append(r)
        elif rank(r["severity"]) > rank(kept[at]["severity"]):
            out.append((kept[at]["seq"], "duplicate", None, None))
            kept[at] = r
        else:
            out.append((r["seq"], "duplicate", None, None))
    taken: set[int] = set()
    fresh = []
    for r in kept:
        choice = next((c for c in (() if r["choices"] is None else r["choices"]) if c["open_id"] not in taken), None)
        if choice is None:
            fresh.append(r)
        else:
            taken.add(choice["open_id"])
            out.append((r["seq"], "update", choice["open_id"], r["severity"] if rank(r["severity"]) > rank(choice["open_severity"]) else None))
    for i, r in enumerate(sorted(fresh, key=lambda r: -rank(r["severity"])) if len(fresh) > most_new else fresh):
        out.append((r["seq"], "insert" if i < most_new else "capped", None, None))
    return pd.DataFrame([(key[0], *o) for o in out], columns=["system_id", "seq", "action", "open_id", "escalated"]).astype({"open_id": "Int64"})


def deduplicated(new: DataFrame, open_findings: DataFrame, threshold: float = 0.5, most_new: int = 5) -> DataFrame:
    """What becomes of each new finding: insert, update (with open_id and a raised severity), duplicate or capped.

    ``new``: system_id, seq (unlike any other of its system), text, severity, criterion_slug and optionally
    ``batch``: what one analysis of one window returned, which is decided together. A batch is greedy in the
    order of ``seq``: first against itself by Jaccard (the more severe stays), then each takes the first of
    its choices among the open findings that the batch has not taken. ``open_findings``: system_id, id, text,
    severity, criterion_slug, status. Batches do not see each other's decisions.

    Similarities are worked out by joins over all findings; one task decides a batch, from its own rows and
    at most as many choices each as the batch has rows.
    """
    batch = F.col("batch").cast("long") if "batch" in new.columns else F.lit(0).cast("long")
    a = stored(fingerprinted(new).select("system_id", "seq", batch.alias("batch"), "severity", "criterion_slug", "tokens", "fingerprint"), "new-findings")
    b = stored(fingerprinted(open_findings.filter("status = 'open'")).select("system_id", "id", "severity", "criterion_slug", "tokens", "fingerprint"), "open-findings")
    most = a.groupBy("system_id", "batch").count().agg(F.max("count")).head()[0] or 1
    choices = stored(candidates(a, b, threshold, most), "choices")
    rows = a.join(choices, ["system_id", "seq"], "left").select("system_id", "batch", "seq", "severity", "criterion_slug", "tokens", "choices")
    return rows.groupBy("system_id", "batch").applyInPandas(lambda key, group: decided(key, group, threshold, most_new), DECISION)


def updated(findings: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Open findings after a window: matched ones recur, have no misses and may only rise in severity."""
    hit = decisions.filter("action = 'update'").select(F.col("open_id").alias("id"), "escalated", F.lit(True).alias("_hit"))
    df = findings.join(hit, "id", "left")
    return df.withColumns({
        "occurrence_count": F.col("occurrence_count") + F.when(F.col("_hit"), 1).otherwise(0), "last_seen_at": F.when(F.col("_hit"), now).otherwise(F.col("last_seen_at")),
        "consecutive_misses": F.when(F.col("_hit"), 0).otherwise(F.col("consecutive_misses")), "severity": F.coalesce("escalated", "severity"),
    }).drop("escalated", "_hit")


def prefix_deduplicated(findings: DataFrame, chars: int = 60) -> DataFrame:
    """The oldest of findings that begin alike (one system and criterion), with the number of all."""
    key = ["system_id", "criterion_slug", "_prefix"]
    df = findings.withColumn("_prefix", F.lower(F.substring("text", 1, chars)))
    w = W.partitionBy(*key)
    return df.withColumns({"n_alike": F.count(F.lit(1)).over(w), "_at": F.row_number().over(w.orderBy("created_at", "id"))}).filter("_at = 1").drop("_prefix", "_at")


def evicted(findings: DataFrame, most: int = 50) -> DataFrame:
    """Open findings beyond a system's cap: the least severe first, then those longest unseen, never seen before all."""
    order = W.partitionBy("system_id").orderBy(sev.finding_rank(F.col("severity"), 2).desc(), F.col("last_seen_at").desc_nulls_last(), F.desc("id"))
    return findings.filter("status = 'open'").withColumn("_at", F.row_number().over(order)).filter(F.col("_at") > most).drop("_at")


def recurring(new: DataFrame, resolved: DataFrame, now: Column, days: int = 14, most: int = 50, threshold: float = 0.5) -> DataFrame:
    """system_id, seq and the resolved finding (newest first) that a new one repeats."""
    recent = resolved.filter((F.col("status") == "resolved") & (F.unix_micros("resolved_at") >= F.unix_micros(now) - days * 86_400_000_000))
    recent = recent.withColumn("_at", F.row_number().over(W.partitionBy("system_id").orderBy(F.desc("resolved_at"), "id"))).filter(F.col("_at") <= most)
    a = fingerprinted(new).withColumn("id", F.col("seq"))
    pairs = jaccard_pairs(a, fingerprinted(recent), threshold).join(recent.select(F.col("id").alias("b_id"), "resolved_at"), "b_id")
    best = F.max_by(F.struct("b_id", "resolved_at", "jaccard"), F.struct("resolved_at", -F.col("b_id")))
    return pairs.groupBy("system_id", F.col("a_id").alias("seq")).agg(best.alias("b")).select("system_id", "seq", F.col("b.b_id").alias("resolved_id"), F.col("b.resolved_at"), F.col("b.jaccard"))


def recurring_text(text: Column, resolved_at: Column) -> Column:
    return F.concat(F.lit("Recurring: "), text, F.lit(" (previously resolved "), F.date_format(resolved_at, "yyyy-MM-dd HH:mm"), F.lit(")"))


def resolution(evidence: Column, references: Column, own_overlap: Column, all_errors: Column, overlap: float = 0.4) -> Column:
    """resolve, or why not: no_references, contradictory, self_reference or still_failing; all but the first count as still active.

    ``own_overlap``: the least overlap, over all referenced events, of the event's words with the
    finding's in either direction; ``all_errors``: whether all referenced events are errors.
    """
    low = F.lower(F.coalesce(evidence, F.lit("")))
    against = F.lit(False)
    for phrase in CONTRADICTIONS:
        against |= low.contains(phrase)
    return F.when(F.size(references) < 1, "no_references").when(against, "contradictory").when(own_overlap >= overlap, "self_reference").when(all_errors, "still_failing").otherwise("resolve")


def evidence_words(text: Column) -> Column:
    """Distinct words of four letters or more, once all but letters, digits and white space is taken out."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", ""), r"\s+"), lambda w: F.length(w) > 3))


def resolutions(answers: DataFrame, findings: DataFrame, events: DataFrame, overlap: float = SELF_OVERLAP) -> DataFrame:
    """finding_id, event_ids and verdict of an analysis' resolutions (see ``resolution``), with overlaps worked out here.

    ``answers``: finding_id, evidence, references (event ids, repeats count once); ``findings``: id, text;
    ``events``: id, message, severity. References to unknown events don't count. An event speaks for the
    finding itself if ``overlap`` or more of either's words are the other's; events without
    words are not looked at, nor are those without a severity.
    """
    asked = answers.select("finding_id", F.explode(F.array_distinct("references")).alias("event_id"))
    told = asked.join(events.select(F.col("id").alias("event_id"), evidence_words(F.col("message")).alias("_said"), (F.regexp_replace(F.coalesce("message", F.lit("")), r"(?i)[^a-z0-9\s]", "") != "").alias("_any"), F.lower(F.trim(F.coalesce("severity", F.lit("")))).alias("_severity")), "event_id")
    told = told.join(findings.select(F.col("id").alias("finding_id"), evidence_words(F.col("text")).alias("_own")), "finding_id")
    shared = F.size(F.array_intersect("_own", "_said"))
    part = lambda c: F.when(F.size(c) > 0, shared / F.greatest(F.size(c), F.lit(1))).otherwise(0.0)
    each = told.withColumn("_overlap", F.when(F.col("_any"), F.greatest(part("_own"), part("_said"))))
    facts = each.groupBy("finding_id").agg(F.array_sort(F.collect_set("event_id")).alias("event_ids"), F.min("_overlap").alias("_least"), F.bool_and(F.when(F.col("_severity") != "", F.col("_severity").isin(*PROBLEMS))).alias("_errors"))
    df = answers.select("finding_id", "evidence").join(facts, "finding_id", "left").withColumn("event_ids", F.coalesce("event_ids", F.array().cast(dict(facts.dtypes)["event_ids"])))
    verdict = resolution(F.col("evidence"), F.col("event_ids"), F.coalesce("_least", F.lit(-1.0)), F.coalesce("_errors", F.lit(False)), overlap)
    return df.select("finding_id", "event_ids", verdict.alias("verdict"))


def missed(findings: DataFrame, seen: DataFrame, anything: bool = True) -> DataFrame:
    """Open findings that a window neither saw nor resolved have one more miss; nothing changes if it classified nothing."""
    if not anything:
        return findings
    df = findings.join(seen.select("id", F.lit(True).alias("_seen")), "id", "left")
    return df.withColumn("consecutive_misses", F.when(F.col("_seen"), 0).when(F.col("status") == "open", F.coalesce("consecutive_misses", F.lit(0)) + 1).otherwise(F.col("consecutive_misses"))).drop("_seen")


def auto_resolved(findings: DataFrame, templates: DataFrame, least: float = 0.5, least_words: int = 2) -> DataFrame:
    """Open findings that a normal-behaviour template explains: its pattern matches, or half of its words are in the finding."""
    f = findings.filter("status = 'open'").withColumn("_words", sim.significant_words(F.col("text")))
    t = templates.filter("enabled").select(F.col("system_id").alias("_system"), "pattern_regex", sim.significant_words(F.regexp_replace("pattern_regex", r"\[\^? ?[^\]]*\]\+?|[\^$\\.*+]", " ")).alias("_own"))
    words = (F.size("_own") >= least_words) & (sim.overlap_ratio(F.col("_own"), F.col("_words")) >= least)
    return f.join(F.broadcast(t), (F.col("_system").isNull() | (F.col("_system") == F.col("system_id"))) & (F.rlike(F.col("text"), F.concat(F.lit("(?i)"), F.col("pattern_regex"))) | words), "left_semi").drop("_words")  # templates: few, written by people


def long_words(text: str) -> Column:
    """Distinct words of four letters or digits and more, in order of the alphabet; none of a null."""
    return F.sort_array(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z0-9]+"), lambda w: F.length(w) >= 4)))


def acknowledged_by(findings: DataFrame, messages: DataFrame, least: float = 0.5) -> DataFrame:
    """Open findings with ``least`` of their words of four letters or more inside one acknowledged message of their system.

    A message with the very words of a finding settles it. What is left meets messages by its rarest words
    only, so many that a message without any of them has too few of the finding's words; those that meet are
    then compared whole, equal sets once.
    """
    named = lambda df, text: df.withColumn("_w", long_words(text)).filter(F.size("_w") > 0).withColumns({"_h1": F.xxhash64("_w"), "_h2": F.xxhash64(F.size("_w"), "_w")})
    key = ["system_id", "_h1", "_h2"]
    f, said = named(findings.filter("status = 'open'"), "text"), named(messages.select("system_id", "message"), "message")
    exact = said.select(*key).distinct().withColumn("_exact", F.lit(True))
    first = stored(f.select("id", *key).join(exact, key, "left"), "settled")
    settled, rest = first.filter("_exact").select("id"), first.filter("_exact is null").drop("_exact")
    if rest.isEmpty():
        return findings.join(settled, "id", "left_semi")

    wanted = stored(f.join(rest.select(*key).distinct(), key, "left_semi").select(*key, "_w").dropDuplicates(key), "wanted")
    told = stored(said.select("system_id", F.col("_h1").alias("_m1"), F.col("_h2").alias("_m2"), "_w").dropDuplicates(["system_id", "_m1", "_m2"]), "told")
    places = told.select("system_id", "_m1", "_m2", F.explode("_w").alias("word"))
    common = places.groupBy("system_id", "word").agg(F.count(F.lit(1)).alias("_df"))
    ranked = wanted.select(*key, F.explode("_w").alias("word")).join(common, ["system_id", "word"], "left")
    ordered = ranked.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("_df"), "word"))).alias("_all"))
    # Of n words k must be shared, so one of any n - k + 1 is; words no message has are the rarest.
    k = F.greatest(F.lit(1), F.ceil(F.size("_all") * least - 1e-9).cast("int"))
    rarest = ordered.select(*key, F.explode(F.slice("_all", F.lit(1), F.greatest(F.lit(0), F.size("_all") - k + 1))).alias("_x")).filter("_x._df > 0").select(*key, F.col("_x.word").alias("word"))
    met = rarest.join(places, ["system_id", "word"]).select(*key, "_m1", "_m2").distinct()
    both = met.join(wanted, key).join(told.withColumnRenamed("_w", "_said"), ["system_id", "_m1", "_m2"])
    hits = both.filter(F.size(F.array_intersect("_w", "_said")) / F.size("_w") >= least).select(*key).distinct()
    return findings.join(settled.unionByName(rest.join(hits, key, "left_semi").select("id")), "id", "left_semi")


def transitioned(findings: DataFrame, ids: DataFrame, to: str, only_from: tuple[str, ...], stamp: str, now: Column) -> DataFrame:
    """Moves chosen findings to a status if they are in one of the given ones."""
    df = findings.join(ids.select("id", F.lit(True).alias("_hit")), "id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & F.col("status").isin(*only_from)
    return df.withColumns({stamp: F.when(hit, now).otherwise(F.col(stamp)), "status": F.when(hit, to).otherwise(F.col("status"))}).drop("_hit")


def context(summaries: DataFrame, findings: DataFrame, n_summaries: int = 5, n_findings: int = 30) -> DataFrame:
    """What an analysis is told, by system: the last summaries and the newest open findings, in order."""
    s = summaries.withColumn("at", F.row_number().over(W.partitionBy("system_id").orderBy(F.desc("to_ts"), "window_id"))).filter(F.col("at") <= n_summaries).select("system_id", F.lit("summary").alias("kind"), "at", F.col("summary").alias("text"))
    f = findings.filter("status = 'open'").withColumn("at", F.row_number().over(W.partitionBy("system_id").orderBy(F.desc("created_at"), "id"))).filter(F.col("at") <= n_findings).select("system_id", F.lit("finding").alias("kind"), "at", "text")
    return s.unionByName(f)


def severity_counts(findings: DataFrame) -> DataFrame:
    """Open findings of each system by severity, and their total."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return findings.filter("status = 'open'").groupBy("system_id").agg(*[n(s) for s in ("critical", "high", "medium", "low", "info")], F.count(F.lit(1)).alias("total"))
