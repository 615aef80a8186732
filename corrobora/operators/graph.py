"""Topic tree, lineage and support: traversals as equi-joins.

Shapes
    nodes(node_id, parent_id, kind, name)   topics(topic_id, node_id, functions, retired)
    links(from_id, from_type, to_id, to_type, rel)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corrobora import vocab
from corrobora.operators.distinct import bitmaps, counts_above
from corrobora.session import ensure_checkpoint_dir, written


# --- tree -------------------------------------------------------------------------

def closure(nodes: DataFrame) -> DataFrame:
    """(root_id, node_id, kind, depth) for every ancestor/descendant pair, however deep.

    Reach doubles each round: every node knows its ancestor ``2 ** k`` levels up and
    takes over what that one has found, so a tree of depth d needs log2(d) rounds.
    The rounds end when they find no new pair.  On a cycle each ancestor counts
    once, at its smallest distance, and a node of the cycle is its own ancestor.
    """
    # Nodes without a row of their own are not climbed through, as in a join on nodes.
    up = (nodes.where("parent_id IS NOT NULL").select("node_id", F.col("parent_id").alias("root_id"))
          .join(nodes.select(F.col("node_id").alias("root_id")), "root_id", "left_semi"))
    up = written(up.select("node_id", "root_id"))
    found = up.select("node_id", "root_id", F.lit(1).cast("long").alias("depth"))
    jump = up
    step, known = 1, found.count()
    while True:
        via = jump.select("node_id", F.col("root_id").alias("via"))
        more = (via.join(found.select(F.col("node_id").alias("via"), "root_id", "depth"), "via")
                .select("node_id", "root_id", (F.col("depth") + step).alias("depth")))
        found = found.unionByName(more).groupBy("node_id", "root_id").agg(F.min("depth").alias("depth"))
        found = written(found)
        now = found.count()
        if now == known:
            break
        jump = written(via.join(jump.select(F.col("node_id").alias("via"), "root_id"), "via").select("node_id", "root_id"))
        step, known = 2 * step, now
    own = nodes.select(F.col("node_id").alias("root_id"), "node_id", "kind", F.lit(0).alias("depth"))
    above = found.join(nodes.select("node_id", "kind"), "node_id").select("root_id", "node_id", "kind", F.col("depth").cast("int").alias("depth"))
    return own.unionByName(above)


def subtree(nodes: DataFrame, root: str) -> DataFrame:
    """Nodes under ``root`` with their depth below it."""
    return closure(nodes).where(F.col("root_id") == root).drop("root_id")


def node_topics(nodes: DataFrame, topics: DataFrame) -> DataFrame:
    """(node_id, topic_id, via): live topics every node reaches.

    A topic homed in the subtree is ``home``; one that only shares a function
    with it is ``link``.  Both routes are equi-joins on the closure, and ``min``
    keeps 'home' over 'link'.
    """
    tree = closure(nodes)
    live = topics.where(~F.col("retired"))
    home = (tree.select(F.col("root_id").alias("at"), "node_id")
            .join(live.select("node_id", "topic_id"), "node_id")
            .select("at", "topic_id", F.lit("home").alias("via")))
    uses = live.select("topic_id", F.explode("functions").alias("node_id"))
    link = (tree.where("kind = 'function'").select(F.col("root_id").alias("at"), "node_id")
            .join(uses, "node_id").select("at", "topic_id", F.lit("link").alias("via")))
    return (home.unionByName(link).groupBy(F.col("at").alias("node_id"), "topic_id")
            .agg(F.min("via").alias("via")))


def tree_violations(nodes: DataFrame) -> DataFrame:
    """(node_id, problem): cycles of any length, roots with a parent, nodes with a lost parent."""
    climbed = closure(nodes)
    cycle = climbed.where((F.col("depth") > 0) & (F.col("root_id") == F.col("node_id"))) \
        .select("node_id", F.lit("cycle").alias("problem")).distinct()
    rooted = nodes.where((F.col("kind") == "root") != F.col("parent_id").isNull()) \
        .select("node_id", F.lit("root_parent").alias("problem"))
    lost = (nodes.where("parent_id IS NOT NULL")
            .join(nodes.select(F.col("node_id").alias("parent_id")), "parent_id", "left_anti")
            .select("node_id", F.lit("lost_parent").alias("problem")))
    return cycle.unionByName(rooted).unionByName(lost)


def levels(nodes: DataFrame) -> DataFrame:
    """Level of each node: its largest distance to an ancestor."""
    return closure(nodes).groupBy("node_id").agg(F.max("depth").alias("level"))


def shared_function_neighbours(topics: DataFrame) -> DataFrame:
    """(topic_id, neighbour_id) of live topics sharing a function, both ways.

    Topics are a catalogue; the neighbours themselves are the result.
    """
    uses = topics.where(~F.col("retired")).select("topic_id", F.explode("functions").alias("f")).distinct()
    other = uses.select(F.col("topic_id").alias("neighbour_id"), "f")
    return (uses.join(other, "f").where("topic_id <> neighbour_id")
            .select("topic_id", "neighbour_id").distinct())


def neighbour_counts(topics: DataFrame) -> DataFrame:
    """(topic_id, functions, neighbours): live topics with how many others share a function with them.

    Counted from the members of each function as bitmaps, so the pairs themselves, whose
    number grows with the square of a function's members, are not made.
    """
    uses = topics.where(~F.col("retired")).select("topic_id", F.explode("functions").alias("f")).where("f IS NOT NULL").distinct()
    # The bit of a topic stands for it in every function; a topic is no neighbour of its own.
    reached = counts_above(uses, "topic_id", "f", bitmaps(uses.select("f", F.col("topic_id").alias("member")), "f", "member"), "reached")
    own = uses.groupBy("topic_id").agg(F.count("*").alias("functions"))
    return own.join(reached, "topic_id").select("topic_id", "functions", (F.col("reached") - 1).alias("neighbours"))


def node_rollup(nodes: DataFrame, topics: DataFrame, live_evidence: DataFrame,
                evidence_sources: DataFrame, signal_evidence: DataFrame) -> DataFrame:
    """Distinct topics, evidence, homed evidence, documents and signals per node.

    Evidence belongs to one topic, so evidence adds up over topics.  Documents
    and signals may repeat across topics: each gets a bit once, topics hold bitmaps,
    and a node ORs those of its topics, so no row per (node, document) is made.
    """
    reach = node_topics(nodes, topics)
    per_topic = live_evidence.groupBy("topic_id").agg(F.count("*").alias("n"))
    by_topic = live_evidence.select("evidence_id", "topic_id")
    counts = (reach.join(per_topic, "topic_id", "left").groupBy("node_id").agg(
        F.count("*").alias("topics"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("evidence"),
        F.coalesce(F.sum(F.when(F.col("via") == "home", F.col("n"))), F.lit(0)).alias("evidence_home")))

    def bridge(edges: DataFrame, column: str, name: str) -> DataFrame:
        pairs = by_topic.join(edges.select("evidence_id", column), "evidence_id")
        return counts_above(reach, "node_id", "topic_id", bitmaps(pairs, "topic_id", column), name)

    out = (nodes.select("node_id", "kind").join(counts, "node_id", "left")
           .join(bridge(evidence_sources, "document_id", "documents"), "node_id", "left")
           .join(bridge(signal_evidence, "signal_id", "signals"), "node_id", "left"))
    return out.na.fill(0, ["topics", "evidence", "evidence_home", "documents", "signals"])


# --- support ------------------------------------------------------------------------

def lose_all_support(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Targets (``to_id``) whose every incoming edge starts in ``removed(from_id)``."""
    flagged = edges.select("from_id", "to_id").join(
        removed.select("from_id").distinct().withColumn("gone", F.lit(True)), "from_id", "left")
    return (flagged.groupBy("to_id").agg(F.bool_and(F.coalesce("gone", F.lit(False))).alias("all_gone"))
            .where("all_gone").select("to_id"))


def cascade(supports: DataFrame, removed: DataFrame, max_rounds: int = 1_000) -> DataFrame:
    """(id, round): the removed objects (round 0) and all that lose their last support, however deep.

    ``supports(from_id, to_id)`` says that ``to_id`` rests on ``from_id``; ``removed(id)``.
    Each round follows only the supports of what the round before took, and takes
    them off the target's counter: a target goes when its counter reaches the number of its
    supports.  So every support is read once in all rounds.  What only holds itself
    up in a circle stays; an object without supports goes only by name.
    """
    edges = written(supports.where("from_id IS NOT NULL AND to_id IS NOT NULL").select("from_id", "to_id").distinct())
    need = edges.groupBy("to_id").agg(F.count("*").alias("need"))
    new = removed.where("id IS NOT NULL").select("id", F.lit(0).alias("round")).distinct()
    new = written(new)
    gone, lost = new, None
    for depth in range(1, max_rounds + 1):
        hit = edges.join(new.select(F.col("id").alias("from_id")), "from_id").groupBy("to_id").agg(F.count("*").alias("lost"))
        lost = hit if lost is None else lost.unionByName(hit).groupBy("to_id").agg(F.sum("lost").alias("lost"))
        lost = written(lost)
        fallen = lost.join(need, "to_id").where("lost = need").select(F.col("to_id").alias("id"))
        new = written(fallen.join(gone.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("round")))
        if new.isEmpty():
            return gone
        gone = gone.unionByName(new)
    raise RuntimeError("the cascade did not settle; raise max_rounds")


def clear_set(evidence: DataFrame, signal_evidence: DataFrame, links: DataFrame,
              topics: DataFrame, uncertainties: DataFrame | None = None) -> DataFrame:
    """(kind, id) of the synthesis objects that rest on the given topics alone.

    Signals go when all their evidence is in the topics; trends and findings
    when all their signals go; risks when all their findings go; with
    ``uncertainties(uncertainty_id, topic_id)``, those of the topics go too.  The kinds
    lie in three layers, so this is ``cascade`` unrolled, without a job of its own.
    """
    inside = evidence.join(topics.select("topic_id"), "topic_id", "left_semi") \
        .select(F.col("evidence_id").alias("from_id"))
    se = signal_evidence.select(F.col("evidence_id").alias("from_id"), F.col("signal_id").alias("to_id"))
    signals = lose_all_support(se, inside).select(F.col("to_id").alias("from_id"))
    from_signals = links.where("from_type = 'signal' AND to_type IN ('trend', 'finding')")
    derived = (lose_all_support(from_signals, signals)
               .join(from_signals.select("to_id", "to_type").distinct(), "to_id"))
    findings = derived.where("to_type = 'finding'").select(F.col("to_id").alias("from_id"))
    risks = lose_all_support(links.where("from_type = 'finding' AND to_type = 'risk'"), findings)
    out = (signals.select(F.lit("signal").alias("kind"), F.col("from_id").alias("id"))
           .unionByName(derived.select(F.col("to_type").alias("kind"), F.col("to_id").alias("id")))
           .unionByName(risks.select(F.lit("risk").alias("kind"), F.col("to_id").alias("id"))))
    if uncertainties is not None:
        open_ = uncertainties.join(topics.select("topic_id"), "topic_id", "left_semi")
        out = out.unionByName(open_.select(F.lit("uncertainty").alias("kind"), F.col("uncertainty_id").alias("id")))
    return out


def without_cleared(rows: DataFrame, refers: dict[str, str | None], cleared: DataFrame) -> DataFrame:
    """Rows left when every object of ``cleared(kind, id)`` is gone.

    ``refers`` names the columns that point at objects, and their kind (None: any); a row
    goes with any of them, and a null points nowhere.
    """
    for column, kind in refers.items():
        ids = cleared if kind is None else cleared.where(F.col("kind") == kind)
        rows = rows.join(ids.select(F.col("id").alias(column)), column, "left_anti").select(*rows.columns)
    return rows


def remove_links(links: DataFrame, cleared: DataFrame) -> DataFrame:
    """Links left when every object of ``cleared(kind, id)`` is gone, on either end."""
    return without_cleared(links, {"from_id": None, "to_id": None}, cleared)


def links_within(links: DataFrame, present: DataFrame) -> DataFrame:
    """Links whose both ends are among ``present(id)``."""
    return (links.join(present.select(F.col("id").alias("from_id")), "from_id", "left_semi")
            .join(present.select(F.col("id").alias("to_id")), "to_id", "left_semi"))


# --- components -----------------------------------------------------------------------

def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root) for every vertex of ``edges(a_id, b_id)``; root = smallest id.

    Alternates the two star steps of Kiveris et al. (2014): each vertex sends its
    larger neighbours, then its smaller ones, to its smallest neighbour.  Rounds
    grow with the logarithm of the size, a hub only ever needs a ``min``
    aggregate, and each round is cut with a checkpoint.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    pairs = (edges.where("a_id <> b_id")
             .select(F.greatest("a_id", "b_id").alias("u"), F.least("a_id", "b_id").alias("v")).distinct())
    pairs = pairs.checkpoint()
    before = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (both.where("v > u").join(lowest, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))   # repeats go with the last distinct
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(small_min, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small_min.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        pairs = small.checkpoint()
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == state:
            break
        before = state
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = pairs.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)


def updated_components(roots: DataFrame, new_edges: DataFrame) -> DataFrame:
    """The components table ``roots(id, root)`` after ``new_edges(a_id, b_id)``: the same as from all edges at once.

    Known components are contracted to their roots first, so only new edges between
    different components are worked on; a component with very many members is
    one vertex, and its members are touched once, when they get another root.
    """
    known = roots.select("id", "root")
    ends = new_edges.where("a_id <> b_id").select("a_id", "b_id")
    for side in ("a", "b"):
        of = known.select(F.col("id").alias(f"{side}_id"), F.col("root").alias(f"{side}_root"))
        ends = ends.join(of, f"{side}_id", "left").withColumn(side, F.coalesce(f"{side}_root", f"{side}_id"))
    ends = written(ends.select("a_id", "b_id", "a", "b"))
    moved = connected_components(ends.select(F.col("a").alias("a_id"), F.col("b").alias("b_id"))).select(F.col("id").alias("root"), F.col("root").alias("to"))
    seen = ends.select(F.col("a_id").alias("id"), F.col("a").alias("root")).unionByName(ends.select(F.col("b_id").alias("id"), F.col("b").alias("root")))
    every = known.unionByName(seen.distinct().join(known.select("id"), "id", "left_anti"))
    return every.join(moved, "root", "left").select("id", F.coalesce("to", "root").alias("root"))


def same_fact(judgements: DataFrame, threshold: float = vocab.SAME_FACT_THRESHOLD) -> DataFrame:
    """(a_id, b_id) of ``judgements(a_id, b_id, same_fact, probability)`` that merge: same fact, and sure enough."""
    return judgements.where(F.col("same_fact") & (F.col("probability") >= threshold) & (F.col("a_id") != F.col("b_id"))).select("a_id", "b_id")


def merge_same_fact(evidence: DataFrame, judgements: DataFrame, bridges: dict[str, DataFrame], roots: DataFrame | None = None,
                    threshold: float = vocab.SAME_FACT_THRESHOLD) -> dict[str, DataFrame]:
    """Fold evidence rows that state the same fact into the smallest of them.

    ``evidence(evidence_id, ...)``; ``bridges`` are the tables that point at ``evidence_id`` (sources,
    signals, entities).  Judgements on rows that are not there do not count.  ``roots`` is the
    table of earlier merges; without it they start anew.  Returns ``roots``, ``evidence``
    without what was folded, and every bridge re-pointed, each row once.
    """
    present = evidence.select("evidence_id")
    pairs = same_fact(judgements, threshold)
    for side in ("a_id", "b_id"):
        pairs = pairs.join(present.select(F.col("evidence_id").alias(side)), side, "left_semi")
    now = connected_components(pairs) if roots is None else updated_components(roots, pairs)
    now = written(now)
    folded = now.where("id <> root").select(F.col("id").alias("evidence_id"))
    out = {"roots": now, "evidence": evidence.join(folded, "evidence_id", "left_anti").select(*evidence.columns)}
    return out | {name: merge_rows(now, rows, "evidence_id") for name, rows in bridges.items()}


def merge_rows(roots: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Re-point the ``key`` of an edge table to its component root, deduplicated."""
    moved = edges.join(roots.select(F.col("id").alias(key), "root"), key, "left")
    return moved.withColumn(key, F.coalesce("root", key)).drop("root").select(*edges.columns).distinct()
