"""Evidence, hypotheses, planning and the ledger, set-based: one row for each item, no objects with state."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions import scalar as S
from larkspan.operators.windows import verified_chain

# Reliability of each kind of source, and the correlation of its items within one class.
RELIABILITY = {"literature": 0.90, "expert_prior": 0.75, "kg_structure": 0.80, "own_omics": 0.95, "public_omics": 0.90, "perturbation": 0.93, "genetic_instrument": 0.92, "clinical": 0.90, "simulation": 0.60, "wetlab": 0.95}
CORRELATION = {"literature": 0.80, "kg_structure": 0.90, "expert_prior": 0.70, "own_omics": 0.60, "public_omics": 0.50, "perturbation": 0.30, "genetic_instrument": 0.20, "clinical": 0.40, "simulation": 0.85, "wetlab": 0.35}
INTERVENTIONAL = ("perturbation", "genetic_instrument", "wetlab")
TEXTUAL = ("literature", "kg_structure")


def _by_kind(kind: Column, values: dict[str, float], other: float) -> Column:
    return functools.reduce(lambda rest, kv: F.when(kind == kv[0], kv[1]).otherwise(rest), values.items(), F.lit(other))


def effective(items: DataFrame) -> DataFrame:
    """Items with the reliability in force (their own or their kind's, times the field's penalty) and the bounded log likelihood ratio."""
    r = S.clip(F.coalesce("reliability", _by_kind(F.col("kind"), RELIABILITY, 0.5)) * F.coalesce("field_penalty", F.lit(1.0)), 0.0, 1.0)
    return items.withColumn("eff_reliability", r).withColumn("eff_lr", S.attenuated_lr("raw_lr", "eff_reliability")).withColumn("log_lr", F.log("eff_lr"))


def aggregate_log_lr(items: DataFrame) -> DataFrame:
    """Sum of log ratios by hypothesis, where the n items of a kind and class count as n / (1 + rho (n - 1))."""
    g = effective(items).groupBy("hid", "kind", "independence_class").agg(F.count("*").alias("n"), F.sum("log_lr").alias("s"))
    scale = 1 / (1 + _by_kind(F.col("kind"), CORRELATION, 0.5) * (F.col("n") - 1))
    return g.withColumn("part", F.col("s") * scale).groupBy("hid").agg(F.sum("part").alias("log_lr"), F.sum("n").alias("n_items"))


def posterior(prior_log_odds: Column, log_lr: Column) -> Column:
    return 1 / (1 + F.exp(-(prior_log_odds + log_lr)))


def prediction_holds(observed: Column, operator: Column, threshold: Column) -> Column:
    close = F.abs(observed - threshold) <= 1e-9 * F.greatest(F.abs(observed), F.abs(threshold))
    return F.when(operator == ">=", observed >= threshold).when(operator == "<=", observed <= threshold).when(operator == ">", observed > threshold).when(operator == "<", observed < threshold).when(operator == "==", close)


def adjudicated(hypotheses: DataFrame, items: DataFrame, predictions: DataFrame, attempts: DataFrame, survive: float = 0.90, refute: float = 0.05, independent: int = 2) -> DataFrame:
    """Next state of each hypothesis, with its posterior and the first guard that blocks it.

    hypotheses: (hid, state, claim, prior_log_odds, proposer); items: evidence; predictions: (hid, critical, operator, threshold, observed); attempts: (hid, actor,
    independent_of, succeeded). Refutation is looked at before survival; a surviving hypothesis that fails a guard is under test again.
    """
    e = items.groupBy("hid").agg(F.bool_or(~F.col("kind").isin(*TEXTUAL)).alias("primary"), F.bool_or(F.col("kind").isin(*INTERVENTIONAL)).alias("intervened"), F.bool_or(F.coalesce("decisive", F.lit(False))).alias("decisive"))
    p = predictions.where("observed is not null").groupBy("hid").agg(F.bool_or(F.col("critical") & ~prediction_holds(F.col("observed"), F.col("operator"), F.col("threshold"))).alias("failed"))
    failed = F.col("succeeded")
    apart = F.col("actor") != F.col("independent_of")
    a = attempts.groupBy("hid").agg(F.bool_or(failed).alias("broken"), F.count_distinct(F.when(~failed & apart, F.col("actor"))).alias("n_independent"))
    h = hypotheses
    for side in (aggregate_log_lr(items), e, p, a):
        h = h.join(side, "hid", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    h = h.withColumn("posterior", posterior(F.col("prior_log_odds"), F.coalesce("log_lr", F.lit(0.0))))
    blocked = (
        F.when(F.col("posterior") < survive, "posterior")
        .when(~no("primary"), "no evidence beyond texts")
        .when((F.col("claim") == "causal") & ~no("intervened"), "no intervention")
        .when(F.coalesce("n_independent", F.lit(0)) < independent, "too few independent attempts")
    )
    judged = F.col("state").isin("under_test", "surviving")
    refuted = no("failed") | no("broken") | no("decisive") | (F.col("posterior") <= refute)
    state = F.when(~judged, F.col("state")).when(refuted, "refuted").when(blocked.isNull(), "surviving").otherwise("under_test")
    return h.select("hid", F.col("state").alias("state_before"), "posterior", F.when(judged & ~refuted, blocked).alias("blocked_by"), state.alias("state"))


def registration_faults(hypotheses: DataFrame, items: DataFrame, predictions: DataFrame) -> DataFrame:
    """What guards forbid: registered hypotheses without predictions, confirming items without registration, items on closed hypotheses."""
    p = predictions.select("hid").distinct().withColumn("__p", F.lit(True))
    a = hypotheses.where("state <> 'proposed'").join(p, "hid", "left").where("__p is null").select("hid", F.lit("no prediction").alias("fault"))
    i = items.join(hypotheses.select("hid", "state", "registered"), "hid")
    b = i.where("confirmatory and not registered").select("hid", F.lit("confirming before registration").alias("fault"))
    c = i.where(F.col("state").isin("refuted", "superseded")).select("hid", F.lit("evidence on a closed hypothesis").alias("fault"))
    return a.union(b).union(c).distinct()


def deg_evidence(degs: DataFrame, fdr_target: float = 0.05) -> DataFrame:
    """Evidence items of tested genes: (gene, contrast, dataset, log2fc, padj, n_a, n_b, expected, composition_adjusted, purity_adjusted).

    Power is the normal approximation at unit deviation; missing adjustments cut the reliability.
    """
    ncp = F.abs("log2fc") / F.sqrt(1.0 / F.col("n_a") + 1.0 / F.col("n_b"))
    power = F.when((F.col("n_a") < 2) | (F.col("n_b") < 2), 0.05).otherwise(S.clip(normal_cdf(ncp - 1.959963985), 0.01, 0.999))
    seen = (F.col("padj") < fdr_target) & (F.when(F.col("log2fc") > 0, "up").otherwise("down") == F.col("expected"))
    r = 0.95 * F.when(F.col("composition_adjusted"), 1.0).otherwise(0.55) * F.when(F.col("purity_adjusted"), 1.0).otherwise(0.75)
    return degs.withColumn("power", power).withColumns({"raw_lr": S.lr_from_test("power", F.lit(fdr_target / 2), seen), "reliability": r, "kind": F.lit("own_omics"), "independence_class": F.concat_ws(":", "dataset", "contrast")})


def literature_evidence(df: DataFrame) -> DataFrame:
    """Items of publications: retracted ones are all but worthless, a contaminated field is marked down."""
    return df.withColumns({"kind": F.lit("literature"), "reliability": F.when(F.col("retracted"), 0.02).cast("double"), "field_penalty": F.when(F.col("ncrna"), 0.75).otherwise(1.0)})


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution in column functions: a power series near 0, a continued fraction in the tail."""
    x = F.abs(z)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("t"), x.alias("s")), lambda a, i: F.struct((a["t"] * x * x / (2 * i + 1)).alias("t"), (a["s"] + a["t"] * x * x / (2 * i + 1)).alias("s")), lambda a: a["s"])
    density = F.exp(-x * x / 2) / 2.5066282746310002
    tail = density / F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda a, i: x + i / a)
    up = F.when(x < 4, 0.5 + density * series).otherwise(1 - tail)
    return F.when(z >= 0, up).otherwise(1 - up)


def candidates(hypotheses: DataFrame, assays: DataFrame, least_bits: float = 0.02) -> DataFrame:
    """Applicable pairs of hypothesis and assay by expected bits for 1,000 of cost; pairs that would open a blocked guard count more.

    hypotheses: (hid, state, claim, posterior, primary, intervened); assays: (aid, kind, sensitivity, specificity, cost, applicable_to, identifies_causal, feasible), a
    list of tens.
    """
    live = hypotheses.where(F.col("state").isin("under_test", "registered"))
    both = live.join(assays.where("feasible"), (F.size("applicable_to") == 0) | F.array_contains("applicable_to", F.col("hid")))
    gain = S.information_gain("posterior", "sensitivity", "specificity")
    unlock = F.when((F.col("claim") == "causal") & ~F.col("intervened") & F.col("identifies_causal"), 2.0).otherwise(1.0) * F.when(~F.col("primary") & ~F.col("kind").isin(*TEXTUAL), 1.5).otherwise(1.0)
    out = both.withColumn("bits", gain).where(F.col("bits") >= least_bits)
    return out.withColumn("score", F.col("bits") * unlock / (F.greatest(F.col("cost"), F.lit(1.0)) / 1000)).orderBy(F.desc("score"), "hid", "aid")


def plan(ranked: DataFrame, budget: float, reserve: float = 0.25) -> list[dict]:
    """Greedy choice within the budget, skipping what is too dear, then a reserve for (mechanism, scale) pairs not yet covered.

    Each choice depends on those before, so the ranked pairs, of a few hypotheses and assays, are walked on the driver.
    """
    rows = [r.asDict() for r in ranked.toLocalIterator()]
    chosen, covered, spent = [], set(), 0.0
    for r in rows:
        if spent + r["cost"] <= budget * (1 - reserve):
            spent += r["cost"]
            covered.add((r.get("mechanism"), r.get("scale")))
            chosen.append(r | {"slot": "optimal"})
    taken, extra = {(r["hid"], r["aid"]) for r in chosen}, 0.0
    for r in rows:
        kind = (r.get("mechanism"), r.get("scale"))
        if kind not in covered and (r["hid"], r["aid"]) not in taken and extra + r["cost"] <= budget * reserve:
            extra += r["cost"]
            covered.add(kind)
            chosen.append(r | {"slot": "diversity_reserve"})
    return chosen


def unidentifiable(hypotheses: DataFrame, assays: DataFrame, least_bits: float = 0.02) -> DataFrame:
    """Hypotheses that no feasible assay informs, with what is missing."""
    informed = hypotheses.join(assays.where("feasible"), S.information_gain("posterior", "sensitivity", "specificity") > least_bits, "left_semi").select("hid")
    rest = hypotheses.join(informed, "hid", "left_anti")
    need = F.array_compact(F.array(F.when((F.col("claim") == "causal") & ~F.col("intervened"), "an intervention"), F.when(~F.col("primary"), "primary data")))
    return rest.select("hid", F.when(F.size(need) > 0, F.array_join(need, "; ")).otherwise("an assay that discriminates").alias("missing"))


def event_digest(columns: Sequence[str]) -> Column:
    return S.content_hash(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def sealed(events: DataFrame, columns: Sequence[str], chain: str = "chain") -> DataFrame:
    """Events (chain, seq, payload, ...) with payload_hash, prev_hash and this_hash.

    Every hash needs the one before, so a chain is one task's, but it is streamed: chains are dealt by hash and sorted, and a task keeps the last hash only, however long a chain is. Time grows with the number of events.
    Events of one seq are in the order of what is hashed.
    """
    own = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = events.withColumn("payload_hash", S.content_hash(F.coalesce(F.col("payload"), F.lit("")))).withColumn("__own", F.concat_ws("|", own, "payload_hash"))
    kept = [c for c in rows.columns if c != "__own"]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = object(), ""
        for batch in batches:
            before, after = [], []
            for c, text in zip(batch.column(chain).to_pylist(), batch.column("__own").to_pylist(), strict=True):
                if c != at:
                    at, last = c, ""
                before.append(last)
                last = sha256(f"{text}|{last}".encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(after, pa.string()), pa.array(before, pa.string())], [*kept, "this_hash", "prev_hash"])

    dealt = rows.repartition(chain).sortWithinPartitions(chain, "seq", "__own")
    return dealt.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "this_hash string", "prev_hash string"]))


def for_subject(events: DataFrame, subject, column: str = "subject") -> DataFrame:
    """A ledger's events on one subject, in order."""
    return events.where(F.col(column) == F.lit(subject)).orderBy("seq")


def first_of(events: DataFrame, kinds: Sequence[str], kind: str = "kind", by: str = "subject") -> DataFrame:
    """The first event of one of the kinds for each subject; aggregated before it is shuffled."""
    rest = [c for c in events.columns if c != by]
    first = events.where(F.col(kind).isin(list(kinds))).groupBy(by).agg(F.min_by(F.struct(*rest), F.col("seq")).alias("e"))
    return first.select(by, "e.*")


def export_ledger(events: DataFrame, path: str) -> None:
    """One JSON object a line; keys are in the order of the columns, and nulls are left out."""
    events.select(F.to_json(F.struct(*events.columns)).alias("value")).write.mode("overwrite").text(path)


def ledger_faults(events: DataFrame, columns: Sequence[str], chain: str = "chain") -> DataFrame:
    """Events of sealed() that were changed since, with the fault: a broken chain, payload or hash."""
    own = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns], F.col("payload_hash"))
    digest = F.sha2(F.concat_ws("|", own, F.col("prev_hash")).cast("binary"), 256)
    ok = S.content_hash(F.coalesce(F.col("payload"), F.lit(""))) == F.col("payload_hash")
    return verified_chain(events, [chain], "seq", "prev_hash", "this_hash", digest, ok).where("fault is not null")


def resolved(names: DataFrame, vocabulary: DataFrame, on: str) -> DataFrame:
    """Names with their vocabulary entries; raises if one is unknown."""
    out = names.join(vocabulary.withColumn("__known", F.lit(True)), on, "left")
    if not out.where("__known is null").isEmpty():
        raise ValueError("names outside the vocabulary")
    return out.drop("__known")
