"""Knowledge-log state: write merging, replay rules, active view, vectors to refresh, consolidation, capture."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerkeep.functions.hashing import content_id
from ledgerkeep.functions.text import strip_temporal_cue
from ledgerkeep.operators.sizing import broadcast_if_small
from ledgerkeep.session import cut

# How answers are stored as memories, and how merged facts are named.
ANSWER_IMPORTANCE = 0.3
MERGED_PREFIX = "merged-"


def _json(value: Column) -> Column:
    """JSON text of one string value, NULL as null."""
    packed = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substring(packed, F.lit(6), F.length(packed) - 6))


def canonical_payload(
    content: Column, importance: Column, metadata: Column, source: Column, supersedes: Column
) -> Column:
    """The record's identity as JSON with sorted keys and spaced separators. ``metadata`` is a map of strings."""
    pairs = F.transform(
        F.array_sort(F.map_entries(metadata)), lambda e: F.concat(_json(e.key), F.lit(": "), _json(e.value))
    )
    return F.concat(
        F.lit('{"content": '), _json(content),
        F.lit(', "importance": '), importance.cast("string"),
        F.lit(', "metadata": {'), F.array_join(pairs, ", "),
        F.lit('}, "source": '), _json(source),
        F.lit(', "supersedes": '), _json(supersedes),
        F.lit("}"),
    )


def with_content_id(records: DataFrame) -> DataFrame:
    payload = canonical_payload(*[F.col(c) for c in ("content", "importance", "metadata", "source", "supersedes")])
    return records.withColumn("memory_id", content_id(payload))


def classify_writes(writes: DataFrame) -> DataFrame:
    """Outcome of writes in sequence order: the first payload of an id is accepted, repeats of it are retries,
    other payloads conflict. ``writes``: memory_id, payload, seq. One row per (memory_id, payload).

    Repeats collapse in the map-side aggregate, so an id retried millions of times moves as one row.
    """
    seen = writes.groupBy("memory_id", F.sha2("payload", 256).alias("payload_hash")).agg(
        F.min("seq").alias("first_seq"), F.count("*").alias("copies")
    )
    first = seen.groupBy("memory_id").agg(F.min("first_seq").alias("id_seq"))
    winner = F.col("first_seq") == F.col("id_seq")
    return seen.join(first, "memory_id").select(
        "memory_id",
        "payload_hash",
        "first_seq",
        winner.cast("long").alias("accepted"),
        F.when(winner, F.col("copies") - 1).otherwise(0).alias("retries"),
        F.when(winner, 0).otherwise(F.col("copies")).cast("long").alias("conflicts"),
    )


def replay_violations(log: DataFrame) -> DataFrame:
    """Log rows that break a replay rule: (seq, memory_id, reason). Everything before the smallest seq is valid.

    ``log``: seq, memory_id, supersedes.
    """
    first = log.groupBy("memory_id").agg(F.min("seq").alias("first_seq"))
    duplicate = log.join(first, "memory_id").where(F.col("seq") > F.col("first_seq"))
    linked = log.where(F.col("supersedes").isNotNull())
    target = first.select(F.col("memory_id").alias("supersedes"), F.col("first_seq").alias("target_seq"))
    unknown = linked.join(target, "supersedes", "left").where(
        F.col("target_seq").isNull() | (F.col("target_seq") >= F.col("seq"))
    )
    taken = linked.groupBy("supersedes").agg(F.min("seq").alias("taken_seq"))
    again = linked.join(taken, "supersedes").where(F.col("seq") > F.col("taken_seq"))

    def tag(rows: DataFrame, reason: str) -> DataFrame:
        return rows.select("seq", "memory_id", F.lit(reason).alias("reason"))

    return (
        tag(duplicate, "duplicate_id")
        .unionByName(tag(unknown, "unknown_or_later_target"))
        .unionByName(tag(again, "already_replaced"))
    )


def first_violation(violations: DataFrame) -> DataFrame:
    return violations.agg(F.min("seq").alias("seq"))


def active_view(log: DataFrame) -> DataFrame:
    """Records that nobody supersedes."""
    replaced = log.where(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("memory_id"))
    return log.join(replaced, "memory_id", "left_anti")


def history_view(log: DataFrame) -> DataFrame:
    """Every record, with a flag for the superseded ones."""
    replaced = log.where(F.col("supersedes").isNotNull()).groupBy(F.col("supersedes").alias("memory_id")).agg(
        F.lit(True).alias("superseded")
    )
    return log.join(replaced, "memory_id", "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))


def lookup(log: DataFrame, memory_id: str) -> DataFrame:
    """One record by id, superseded or not; the filter reaches the scan where the id is a stored column."""
    return log.where(F.col("memory_id") == memory_id)


def admissible(batch: DataFrame, log: DataFrame) -> DataFrame:
    """Flag batch rows whose ``supersedes`` is empty or active in a settled log."""
    active = active_view(log).select(F.col("memory_id").alias("supersedes"), F.lit(True).alias("_active")).distinct()
    free = F.col("supersedes").isNull()
    return batch.join(active, "supersedes", "left").withColumn(
        "admitted", free | F.coalesce("_active", F.lit(False))
    ).drop("_active")


def admit_batch(writes: DataFrame) -> DataFrame:
    """Sequential admission inside one batch: seq (unique), memory_id, supersedes plus ``admitted``.

    A row is admitted if it is the first admitted row of its id and its target is an earlier admitted row not yet
    superseded by an admitted one. A round judges the undecided rows by what the round before admitted. A row that waits for
    one undecided row only follows or negates that row's verdict; chains of such rows are composed by pointer
    doubling, so a chain of any length takes a logarithmic number of joins. The first undecided row of the log is decided in
    every round; rows that wait for several others take further rounds. Decided rows are written once and not read
    again by later rounds, but for the admitted ones, which the next round tells to the rows that name them.
    """
    names = ["seq", "memory_id", "supersedes"]
    # met: the target is known to be an earlier admitted row
    undecided = cut(writes.select(*names, F.lit(False).alias("met")))
    fresh, parts = None, []
    while not undecided.isEmpty():
        judged = cut(_judge(undecided, fresh))
        decided, undecided = [judged], judged.where("admitted is null and dep is null").select(*names, "met")
        tied = judged.where("dep is not null")
        if not tied.isEmpty():
            verdicts = _compose(judged)
            tied = cut(tied.drop("admitted", "dep", "negates").join(verdicts, "seq", "left"))
            decided.append(tied)
            undecided = undecided.unionByName(tied.where("admitted is null").select(*names, "met"))
        decided = [part.where("admitted is not null").select(*names, "admitted") for part in decided]
        fresh = reduce(DataFrame.unionByName, decided).where("admitted").select(*names)
        parts += decided
    return reduce(DataFrame.unionByName, parts) if parts else undecided.select(*names, F.lit(None).cast("boolean").alias("admitted"))


def _named(undecided: DataFrame, fresh: DataFrame | None) -> DataFrame:
    """Per name of an undecided row: the first freshly admitted row that has it as id (``it``) or target (``ct``), and the two
    first undecided ones (``i1``, ``i2``; ``c1``, ``c2``)."""
    rows = undecided.select("seq", "memory_id", "supersedes", F.lit(True).alias("open"))
    if fresh is not None:
        rows = rows.unionByName(fresh.withColumn("open", F.lit(False)))
    said = rows.select(F.col("memory_id").alias("name"), "seq", "open", F.lit(True).alias("has")).unionByName(
        rows.select(F.col("supersedes").alias("name"), "seq", "open", F.lit(False).alias("has"))
    ).where(F.col("name").isNotNull())
    roles = {"i": F.col("has"), "c": ~F.col("has")}
    aggs = []
    for p, role in roles.items():
        waiting = F.when(role & F.col("open"), F.col("seq"))
        aggs += [F.min(F.when(role & ~F.col("open"), F.col("seq"))).alias(f"{p}t"), F.min(waiting).alias(f"{p}1"), F.max(waiting).alias(f"{p}m"), F.bit_xor(waiting).alias(f"{p}x"), F.count(waiting).alias(f"{p}n")]

    def second(p: str) -> Column:
        """Of two rows the last, of three the one left over; of more it is looked up."""
        n, last = F.col(f"{p}n"), F.col(f"{p}m")
        middle = F.col(f"{p}x").bitwiseXOR(F.col(f"{p}1")).bitwiseXOR(last)
        return F.when(n == 2, last).when(n == 3, middle).alias(f"{p}2")

    groups = said.groupBy("name").agg(*aggs).where("i1 is not null or c1 is not null")
    groups = cut(groups.select("name", "it", "i1", second("i"), "in", "ct", "c1", second("c"), "cn"))
    crowded = groups.where("in > 3 or cn > 3")
    if not crowded.isEmpty():
        later = said.where("open").join(crowded.select("name", "i1", "c1"), "name")
        seconds = later.groupBy("name").agg(*[F.min(F.when(role & (F.col("seq") > F.col(f"{p}1")), F.col("seq"))).alias(f"{p}s") for p, role in roles.items()])
        groups = cut(groups.join(seconds, "name", "left").withColumns({"i2": F.coalesce("is", "i2"), "c2": F.coalesce("cs", "c2")}))
    return groups.select("name", "it", "i1", "i2", "ct", "c1", "c2")


def _judge(undecided: DataFrame, fresh: DataFrame | None) -> DataFrame:
    """Undecided rows with what follows from freshly admitted ones: ``admitted``, or the only row ``dep`` it waits for and whether
    it ``negates`` that row's verdict; both are NULL for a row that waits for several."""
    groups = _named(undecided, fresh)
    ids = groups.select(F.col("name").alias("memory_id"), "it", "i1", "i2")
    targets = groups.select(F.col("name").alias("_key"), F.col("it").alias("gt"), F.col("i1").alias("g1"), F.col("i2").alias("g2"), "ct", "c1", "c2")
    # rows without a target look up their own id, so that they do not meet in one partition; nothing of it is used
    rows = undecided.join(ids, "memory_id", "left").withColumn("_key", F.coalesce("supersedes", "memory_id")).join(targets, "_key", "left")
    linked = F.col("supersedes").isNotNull()
    earlier = lambda c: F.coalesce(F.col(c) < F.col("seq"), F.lit(False))
    met = ~linked | F.col("met") | earlier("gt")  # the target is there
    waits = ~met & earlier("g1")
    refused = earlier("it") | (linked & earlier("ct")) | (~met & ~earlier("g1"))
    several = earlier("i2") | (waits & earlier("g2")) | (linked & earlier("c2"))
    deps = F.array_distinct(F.filter(F.array(F.when(earlier("i1"), F.col("i1")), F.when(waits, F.col("g1")), F.when(linked & earlier("c1"), F.col("c1"))), lambda d: d.isNotNull()))
    on = F.get(deps, 0)
    yes = ~(earlier("i1") & (F.col("i1") == on)) & ~(linked & earlier("c1") & (F.col("c1") == on)) & (met | (waits & (F.col("g1") == on)))
    verdict = F.when(refused, False).when(several | (F.size(deps) > 1), F.lit(None)).when(F.size(deps) == 0, True).when(yes == met, met)
    rows = rows.select("seq", "memory_id", "supersedes", met.alias("met"), verdict.alias("admitted"), several.alias("_several"), deps.alias("_deps"))
    single = F.col("admitted").isNull() & ~F.col("_several") & (F.size("_deps") == 1)
    return rows.select("seq", "memory_id", "supersedes", "met", "admitted", F.when(single, F.get("_deps", 0)).alias("dep"), F.when(single, F.col("met")).alias("negates"))


def _compose(judged: DataFrame) -> DataFrame:
    """(seq, admitted) of the rows whose chain of ``dep`` ends at a decided row, by pointer doubling over rows that move."""
    settled = judged.where("admitted is not null").select(F.col("seq").alias("dep"), F.col("admitted").alias("_a"))
    links = judged.where("dep is not null").select("seq", "dep", "negates")
    after = cut(links.join(settled, "dep", "left").select("seq", (F.col("_a") != F.col("negates")).alias("admitted"), "dep", "negates"))
    found, links = after.where("admitted is not null"), after.where("admitted is null")
    while not links.isEmpty():
        # found and links name each row once; a link to none of them ends at a row that waits for several, and stays open
        known = found.select(F.col("seq").alias("dep"), F.col("admitted").alias("_a"), F.lit(None).cast(links.schema["dep"].dataType).alias("_d"), F.lit(None).cast("boolean").alias("_n"))
        at = known.unionByName(links.select(F.col("seq").alias("dep"), F.lit(None).cast("boolean").alias("_a"), F.col("dep").alias("_d"), F.col("negates").alias("_n")))
        after = cut(links.join(at, "dep").select(
            "seq", (F.col("_a") != F.col("negates")).alias("admitted"), F.col("_d").alias("dep"), (F.col("negates") != F.col("_n")).alias("negates")
        ))
        found, links = found.unionByName(after.where("admitted is not null")), after.where("admitted is null")
    return found.select("seq", "admitted")


def missing_vectors(records: DataFrame, vectors: DataFrame, version: str, dimension: int) -> DataFrame:
    """Records without a usable vector of this embedding version."""
    usable = vectors.where(
        (F.col("embedding_version") == version)
        & (F.size("vector") == dimension)
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    return records.join(usable, "memory_id", "left_anti")


def stale_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids whose content changed or vanished since the vectors were made."""
    before = old.select("memory_id", F.col("content").alias("_old"))
    after = new.select("memory_id", F.col("content").alias("_new"))
    return before.join(after, "memory_id", "left").where(~F.col("_old").eqNullSafe(F.col("_new"))).select("memory_id")


def consolidate(records: DataFrame, keep_cue: bool = False) -> DataFrame:
    """The latest record per (subject, relation) by (event_order, memory_id), renamed as a merged fact.

    ``source_count`` counts the records behind it; ``provenance`` lists them as rows, since a fact may have
    any number of sources.
    """
    latest = records.groupBy("subject", "relation").agg(
        F.max_by(F.struct("memory_id", "canonical_id", "content"), F.struct("event_order", "memory_id")).alias("m"),
        F.count("*").alias("source_count"),
    )
    content = F.col("m.content") if keep_cue else strip_temporal_cue(F.col("m.content"))
    return latest.select(
        "subject",
        "relation",
        F.concat(F.lit(MERGED_PREFIX), F.col("m.memory_id")).alias("memory_id"),
        F.col("m.canonical_id").alias("canonical_id"),
        content.alias("content"),
        "source_count",
    )


def provenance(records: DataFrame, facts: DataFrame) -> DataFrame:
    """(merged id, source id) rows."""
    return records.select("subject", "relation", F.col("memory_id").alias("source_id")).join(
        broadcast_if_small(facts.select("subject", "relation", "memory_id")), ["subject", "relation"]
    ).select("memory_id", "source_id")


def answer_memories(answers: DataFrame) -> DataFrame:
    """Generated answers as unverified memories that cite their evidence. ``answers``: content, hits (structs)."""
    metadata = F.to_json(F.struct(F.transform("hits", lambda h: h.memory_id).alias("evidence_ids"), F.lit(False).alias("verified")))
    return answers.withColumns(
        {"importance": F.lit(ANSWER_IMPORTANCE), "source": F.lit("generated_answer"), "metadata": metadata}
    )


def capture(turns: DataFrame, strategy: str, limit: int, include_assistant: bool = True) -> DataFrame:
    """Messages to remember of each session: from the last user turn on, or the full session.

    Texts longer than ``limit`` are cut and marked. Only user and assistant messages count.
    """
    roles = ["user", "assistant"] if include_assistant else ["user"]
    kept = turns.where(F.col("role").isin(roles))
    if strategy == "last_turn":
        last = turns.where(F.col("role") == "user").groupBy("conv_id").agg(F.max("turn").alias("_last"))
        kept = kept.join(last, "conv_id").where(F.col("turn") >= F.col("_last"))
    elif strategy != "full_session":
        raise ValueError(f"unknown capture strategy {strategy}")
    text = F.col("text")
    cut_text = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)
    return kept.select("conv_id", "turn", "role", cut_text.alias("text"))


def assemble_conditions(cases: DataFrame, distractors: DataFrame) -> DataFrame:
    """Contents shown for each case under each condition, as one map per case; without a distractor, ``irrelevant`` is left out.

    ``cases``: case_id, relation, current and old (structs with memory_id, content, event_order), swap (order of
    the conflicting pair). ``distractors``: relation, memory_id, content, event_order; the first by event_order is used.
    """
    first = distractors.groupBy("relation").agg(
        F.min_by(F.struct("memory_id", "content", "event_order"), F.struct("event_order", "memory_id")).alias("unrelated")
    )
    current, old = F.col("current"), F.col("old")
    merged = F.struct(
        F.concat(F.lit(MERGED_PREFIX), current.memory_id).alias("memory_id"),
        strip_temporal_cue(current.content).alias("content"),
        current.event_order.alias("event_order"),
    )
    kept = merged.withField("content", current.content)
    none = F.filter(F.array(current), lambda m: F.lit(False))
    conditions = F.create_map(
        F.lit("no_memory"), none,
        F.lit("relevant"), F.array(current),
        F.lit("irrelevant"), F.array(F.col("unrelated")),
        F.lit("conflicting"), F.when(F.col("swap"), F.array(old, current)).otherwise(F.array(current, old)),
        F.lit("consolidation_keep_temporal_cue"), F.array(kept),
        F.lit("consolidation_strip_temporal_cue"), F.array(merged),
    )
    shown = F.map_filter(conditions, lambda name, _: (name != "irrelevant") | F.col("unrelated").isNotNull())
    return cases.join(broadcast_if_small(first), "relation", "left").withColumn("conditions", shown)


def explode_conditions(cases: DataFrame) -> DataFrame:
    """One row per case and condition."""
    others = [c for c in cases.columns if c != "conditions"]
    return cases.select(*others, F.explode("conditions").alias("condition", "memories"))
