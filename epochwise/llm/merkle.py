"""A content-addressed manifest of a dataset: Merkle trees over sources, proofs by descent.

Every row is a leaf. The leaves of a source make a tree whose nodes are the digests of
three consecutive children; the trees' tops, ordered by source, make one more tree.

* The store maps digests to children. Its records are pages: the top digest of a
  subtree of at most four levels, and all digests below it. Equal subtrees have equal
  digests and share a page.
* A request is a source and a rank. It starts at the root, reads the page of the digest
  it stands at, and goes down by the digits of its rank in base three, collecting the
  children it does not select. The segments collected on the way down are reversed and
  put before what was collected above, which gives the proof from leaf to root.

Ranks come from a range shuffle of digests, so one source may hold most rows. Requests
descend together: those below one page are one row until the last page, so the tables of
the upper levels have a row for each page, not for each leaf.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwise.llm.common import named
from epochwise.operators.numbering import number_by_range
from epochwise.storage import stage

FANOUT = 3
# Levels of a page, and so 3 ** _PAGE_LEVELS digests in its lowest one.
_PAGE_LEVELS = 4
_PAGE = FANOUT**_PAGE_LEVELS
_NO_PATH = "cast(array() as array<struct<l: string, r: string>>)"

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class Tree:
    """Trees of digests, one for each group: the store and where its descents begin.

    ``store``: digest, levels (lowest first) and height of every page. ``tops``: grp, n,
    depth and digest of each group's tree. ``passes`` is the largest number of pages
    between a top and a leaf.
    """

    store: DataFrame
    tops: DataFrame
    passes: int


def _field(value: Column) -> Column:
    """``-`` for a null, else the number of UTF-8 bytes, a colon and the value."""
    told = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(_field, values)), 256)


def group_key(group: Column) -> Column:
    """A key that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


_PARENTS = f"""
transform(sequence(0, cast((size({{0}}) - 1) div {FANOUT} as int)),
          i -> sha2(array_join(slice({{0}}, {FANOUT} * i + 1, {FANOUT}), ''), 256))"""

_LEVELS = f"""
aggregate(if(height = 0, cast(array() as array<int>), sequence(1, height)), array(nodes),
          (below, t) -> concat(below, array({_PARENTS.format("element_at(below, -1)")})))"""


def _pages(nodes: DataFrame, sizes: DataFrame, level: int) -> DataFrame:
    """Pages (grp, page, height, levels, digest) over the nodes (grp, rank, digest) of a level."""
    ordered = nodes.groupBy("grp", F.expr(f"rank div {_PAGE}").alias("page")).agg(
        F.expr("transform(sort_array(collect_list(struct(rank, digest))), x -> x.digest)").alias("nodes")
    )
    high = ordered.join(sizes.select("grp", "depth"), "grp").withColumn(
        "height", F.expr(f"cast(least({_PAGE_LEVELS}, depth - {level}) as int)")
    )
    built = high.withColumn("levels", F.expr(_LEVELS)).select("grp", "page", "height", "depth", "levels")
    return built.withColumn("digest", F.expr("element_at(levels, -1)[0]"))


def build_trees(leaves: DataFrame, order: Sequence[str]) -> tuple[Tree, DataFrame]:
    """Trees over ``leaves`` (grp, digest and more), and the leaves with their rank in the group.

    ``order`` must tell all rows of a group apart. A group's only leaf is its tree.
    """
    ranked, totals = number_by_range(leaves, ["grp"], order, "rank")
    # Digits of a rank: the powers of three below the number of leaves.
    sizes = stage(
        totals.selectExpr("grp", "rows AS n", f"size(filter(sequence(0, 40), t -> pow({FANOUT}, t) < rows)) AS depth"),
        "merkle-sizes",
    )
    depth = sizes.agg(F.max("depth")).first()[0] or 0
    nodes, written = ranked.select("grp", "rank", "digest"), []
    for level in range(0, max(depth, 1), _PAGE_LEVELS):
        pages = stage(_pages(nodes, sizes, level), "merkle-pages")
        written.append(pages)
        nodes = pages.where(F.col("depth") > level + _PAGE_LEVELS).selectExpr("grp", "page AS rank", "digest")
    every, tops = written[0], []
    for pages in written[1:]:
        every = every.unionAll(pages)
    for level, pages in enumerate(written):
        last = f"greatest(cast(ceil(depth / {_PAGE_LEVELS}) as int), 1) = {level + 1}"
        tops.append(pages.where(last).select("grp", "digest"))
    top = tops[0]
    for more in tops[1:]:
        top = top.unionAll(more)
    store = every.select("digest", "height", "levels").dropDuplicates(["digest"])
    return Tree(store, stage(sizes.join(top, "grp"), "merkle-tops"), len(written)), ranked


# What a descent through one page leaves aside, from the top down, a struct for each level.
_DOWN = f"""
transform(if(height = 0, cast(array() as array<int>), sequence(height - 1, 0, -1)),
          t -> named_struct('run', levels[t], 'at', cast(floor(a.slot / pow({FANOUT}, t)) as int)))"""
_SIBLINGS = f"""
transform(reverse({_DOWN}), x -> struct(
    array_join(slice(x.run, x.at - x.at % {FANOUT} + 1, x.at % {FANOUT}), '') AS l,
    array_join(slice(x.run, x.at + 2, {FANOUT - 1} - x.at % {FANOUT}), '') AS r))"""


def _descend(state: DataFrame, store: DataFrame, wanted: DataFrame) -> DataFrame:
    """One page down: (grp, page, slot, carried) to (grp, carried, digest, path, top)."""
    asked = wanted.groupBy("grp", "page").agg(F.collect_list(F.struct("slot", "carried")).alias("asked"))
    return (
        asked.join(state, ["grp", "page"])
        .join(store, "digest")
        .selectExpr(
            "grp",
            "top",
            f"""inline(transform(asked, a -> struct(
                a.carried AS carried, levels[0][a.slot] AS digest, concat({_SIBLINGS}, path) AS path)))""",
        )
    )


def descend(tree: Tree, starts: DataFrame, requests: DataFrame) -> DataFrame:
    """Proofs of ``requests`` (grp, rank, carried): grp, top, carried, digest and path.

    ``starts`` has for each group the path above its top digest and what is carried along
    as ``top``: (grp, path, top). ``path`` is an array from the leaf upwards of what stands
    left and right of the selected node. A rank that its group does not have is an error.
    """
    begin = tree.tops.join(starts, "grp").withColumn(
        "at", F.expr(f"greatest(cast(ceil(depth / {_PAGE_LEVELS}) as int), 1) - 1")
    )
    found: DataFrame | None = None
    for step in range(tree.passes - 1, -1, -1):
        state = begin.where(F.col("at") == step).select("grp", F.lit(0).cast("long").alias("page"), "digest", "path", "top")
        if found is not None:
            state = state.unionByName(found.selectExpr("grp", "carried AS page", "digest", "path", "top"))
        if step:
            # Pages of the next pass on the way to a request, each once.
            below = requests.selectExpr("grp", f"cast(rank div {_PAGE**step} as bigint) AS child").distinct()
            wanted = below.selectExpr(
                "grp", f"child div {_PAGE} AS page", f"cast(child % {_PAGE} as int) AS slot", "child AS carried"
            )
            found = stage(_descend(state, tree.store, wanted), "merkle-state")
        else:
            wanted = requests.selectExpr("grp", f"rank div {_PAGE} AS page", f"cast(rank % {_PAGE} as int) AS slot", "carried")
            return _descend(state, tree.store, wanted)
    raise AssertionError("a tree has at least one pass")


def proof_digest(path: str) -> Column:
    """The digest of all siblings of a path, from leaf to root and left to right."""
    return F.expr(f"sha2(array_join(transform({path}, x -> concat(x.l, x.r)), ''), 256)")


def folded(path: str, start: str) -> Column:
    """The root that a leaf and its siblings give."""
    return F.expr(f"aggregate({path}, {start}, (node, x) -> sha2(concat(x.l, node, x.r), 256))")


def proofs(leaves: DataFrame, order: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """For every row of ``leaves`` (grp, digest, ...): ``carried``, leaf, subroot, root and path."""
    sources, ranked = build_trees(leaves, order)
    subroots = sources.tops.selectExpr("'' AS grp", "grp AS member", "digest")
    whole, members = build_trees(stage(subroots, "merkle-subroots"), ["member"])
    starts = whole.tops.selectExpr("grp", f"{_NO_PATH} AS path", "digest AS top")
    asked = members.selectExpr("grp", "rank", "member AS carried")
    above = descend(whole, starts, asked).selectExpr(
        "carried AS grp", "path", "named_struct('subroot', digest, 'root', top) AS top"
    )
    requests = ranked.select("grp", "rank", F.struct(*carried).alias("carried"))
    found = descend(sources, stage(above, "merkle-starts"), requests)
    return found.selectExpr("carried.*", "digest AS leaf", "top.subroot", "top.root", "path")


def dataset_manifest(
    docs: DataFrame,
    tampered: Column | None = None,
    group_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    fields: Sequence[str] = FIELDS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    ``tampered`` marks rows whose text is read back without its newlines: their
    folded_root is made of that text and the siblings of the original. Nulls are a value
    of their own in any field; a null id comes first in its source and is never marked
    by a null mark. Repeated rows are leaves of their own, next to each other. A null
    source is a group of its own, before all others. An empty table has no rows.
    """
    text = named(text_col)
    bare = F.translate(text.cast("string"), "\n", "")
    original = leaf_digest([named(c) for c in fields])
    changed = leaf_digest([bare if c == text_col else named(c) for c in fields])
    mark = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    leaves = docs.select(
        group_key(named(group_col)).alias("grp"),
        named(id_col).alias("doc_id"),
        original.alias("digest"),
        # Only rows that are read back changed have a second digest.
        F.when(mark, changed).alias("read_back"),
        F.monotonically_increasing_id().alias("row"),
    )
    found = proofs(stage(leaves, "merkle-leaves"), ["doc_id", "row"], ["doc_id", "read_back"])
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest("path").alias("proof_sha256"),
        folded("path", "coalesce(read_back, leaf)").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
