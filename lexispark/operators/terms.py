"""Term lists: state, patches, votes, roots, and building a list from a corpus.

A list's state is a table (term, size, list, root, parent, children); changes are rows of an append-only log.
Where an order must be chosen it is stated: the smallest term wins, later versions win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rank of list kinds; the greater one wins where lists meet. Fixed values.
RANKS = {"CandidateTerm": 0, "StopTerm": 1, "MapTerm": 2}
#: Orders of a term table: column and direction.
TERM_ORDERS = {"TermAsc": ("term", True), "TermDesc": ("term", False), "ScoreAsc": ("score", True), "ScoreDesc": ("score", False)}
#: Quotas of a built list: share of single words, share by inclusion, sizes of the parts. Fixed values.
QUOTAS = {"mono": 0.4, "inclusion": 0.4, "map": 1000, "candidates": 1000, "global": 2000, "lemmas": 350}


def rank_of(kind: str = "list") -> Column:
    out = F.lit(-1)
    for name, r in RANKS.items():
        out = F.when(F.col(kind) == name, r).otherwise(out)
    return out


def strongest(kind: str = "list") -> Column:
    """Aggregate: the list kind of greatest rank."""
    return F.max_by(kind, rank_of(kind))


def with_root_list(state: DataFrame) -> DataFrame:
    """Each term with the list kind of its root, or its own."""
    roots = state.select(F.col("term").alias("root"), F.col("list").alias("root_list"))
    return state.join(roots, "root", "left").withColumn("effective", F.coalesce("root_list", "list"))


def of_lists(state: DataFrame, kinds: list[str]) -> DataFrame:
    """Terms whose own or root's list is one of these. A root that isn't in the list is an error."""
    s = with_root_list(state)
    bad = F.col("root").isNotNull() & F.col("root_list").isNull()
    checked = s.withColumn("effective", F.when(bad, F.raise_error(F.concat(F.lit("unknown root "), F.col("root")))).otherwise(F.col("effective")))
    return checked.where(F.col("effective").isin(kinds)).drop("root_list")


def search_terms(state: DataFrame, *, kind: str | None = None, part: str | None = None, least: int | None = None, most: int | None = None, order: str = "ScoreDesc", offset: int = 0, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(page, count): terms of a list by size, kind and substring, as their roots with the documents of all members, ordered and cut.

    state: term, size, list, root, parent, children, occurrences (array of document ids).
    """
    hit = state
    if kind is not None:
        hit = hit.where(F.col("list") == kind)
    if least is not None:
        hit = hit.where(F.col("size") >= least)
    if most is not None:
        hit = hit.where(F.col("size") <= most)
    if part:
        hit = hit.where(F.lower("term").contains(part.lower()))
    roots = hit.select(F.coalesce("root", "term").alias("term")).distinct()
    docs = state.select(F.coalesce("root", "term").alias("term"), F.explode_outer("occurrences").alias("d")).groupBy("term").agg(F.countDistinct("d").alias("score"))
    found = state.join(roots, "term", "left_semi").join(docs, "term", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    name, up = TERM_ORDERS[order]
    page = found.orderBy(F.col(name).asc() if up else F.col(name).desc(), "term")
    page = page.offset(offset) if offset else page
    return (page if limit is None else page.limit(limit)), found.agg(F.count("*").alias("n"))


def apply_patches(state: DataFrame, patches: DataFrame) -> DataFrame:
    """State after patches (version, term, old_list, new_list): the last version of each term wins, and a changed list kind goes to the term's direct children.

    A patch holds where its old list kind is what the state has; unknown terms are left out.
    """
    last = patches.groupBy("term").agg(F.max_by("new_list", "version").alias("new_list"), F.min_by("old_list", "version").alias("old_list"))
    own = state.join(last, "term").where(F.col("list") == F.col("old_list")).select("term", "new_list", F.coalesce("children", F.array().cast("array<string>")).alias("children"))
    down = own.select(F.explode("children").alias("term"), F.col("new_list").alias("down")).groupBy("term").agg(strongest("down").alias("down"))
    out = state.join(own.select("term", "new_list"), "term", "left").join(down, "term", "left")
    return out.withColumn("list", F.coalesce("new_list", "down", "list")).select(*state.columns)


def reroot(state: DataFrame, moved: DataFrame) -> DataFrame:
    """State after terms got new parents (term, parent): roots follow down the whole subtree, one equi-join a level."""
    s = state.join(moved.select("term", F.col("parent").alias("_p"), F.lit(True).alias("_m")), "term", "left").withColumn("parent", F.when(F.col("_m"), F.col("_p")).otherwise(F.col("parent"))).drop("_p", "_m")
    from . import tree

    nodes = s.select(F.col("term").alias("id"), F.col("parent").alias("parent_id"))
    tops = nodes.where("parent_id IS NULL").select("id")
    below = tree.descendants(nodes, tops).select(F.col("id").alias("term"), F.col("root").alias("_root"), "depth")
    return s.join(below, "term", "left").withColumn("root", F.when(F.col("depth") > 0, F.col("_root"))).select(*state.columns)


def votes(patches: DataFrame) -> DataFrame:
    """(term, list, vote): each patch votes against the old list kind and for the new one."""
    against = patches.where("old_list IS NOT NULL").select("term", F.col("old_list").alias("list"), F.lit(-1).alias("v"))
    return against.unionByName(patches.where("new_list IS NOT NULL").select("term", F.col("new_list").alias("list"), F.lit(1).alias("v"))).groupBy("term", "list").agg(F.sum("v").alias("vote"))


def elected(vote: DataFrame) -> DataFrame:
    """(term, list): the kind of most votes, if above 0; ties to the kind of greater rank."""
    best = vote.groupBy("term").agg(F.max(F.struct("vote", rank_of().alias("r"), "list")).alias("b"))
    return best.where("b.vote > 0").select("term", F.col("b.list").alias("list"))


def merge_states(states: DataFrame, position: str = "version") -> DataFrame:
    """One row a term of several states: that of the last position."""
    return states.withColumn("_r", F.row_number().over(Window.partitionBy("term").orderBy(F.desc(position), "list"))).where("_r = 1").drop("_r")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Patches that lead from one state to another: (term, old_list, new_list) where they differ."""
    o, n = old.select("term", F.col("list").alias("old_list")), new.select("term", F.col("list").alias("new_list"))
    return o.join(n, "term", "full").where(~F.col("old_list").eqNullSafe(F.col("new_list")))


def grouped_forms(terms: DataFrame, key: Column | None = None, lang: str = "en") -> DataFrame:
    """(term, root): forms whose words have the same stems, whatever their order, under the smallest of them. Distinct terms only are stemmed."""
    from ..functions.stem import group_key_udf

    k = terms.select("term").distinct().withColumn("_k", key if key is not None else group_key_udf(lang)("term"))
    roots = k.groupBy("_k").agg(F.min("term").alias("root"), F.count("*").alias("n")).where("n > 1")
    return k.join(roots, "_k").select("term", "root")


def roots_with_members(state: DataFrame) -> DataFrame:
    """(root, members): each root with its forms, sorted."""
    return state.groupBy(F.coalesce("root", "term").alias("root")).agg(F.array_sort(F.collect_set("term")).alias("members"))


def pull(log: DataFrame, version: int) -> DataFrame:
    """Patches after a version; of each term the last one, ours over theirs where a column `ours` says so."""
    since = log.where(F.col("version") > version)
    return since.groupBy("term").agg(F.max_by(F.struct("old_list", "new_list"), "version").alias("p"), F.max("version").alias("version")).select("term", "p.old_list", "p.new_list", "version")


def history(log: DataFrame, after: int = 0) -> DataFrame:
    """The log's patches after a version, newest first; within a version by term."""
    return log.where(F.col("version") > after).orderBy(F.desc("version"), "term")


def state_at(state: DataFrame, log: DataFrame, version: int | None = None) -> DataFrame:
    """(term, list): a first state (term, list) with the log's patches up to a version; the last one of a term wins, one to null takes it away."""
    upto = log if version is None else log.where(F.col("version") <= version)
    last = upto.groupBy("term").agg(F.max_by(F.struct("new_list"), "version").alias("p"))
    out = state.select("term", "list").join(last, "term", "full").select("term", F.when(F.col("p").isNotNull(), F.col("p.new_list")).otherwise(F.col("list")).alias("list"))
    return out.where("list IS NOT NULL")


def commit(log: DataFrame, patches: DataFrame, base: int) -> tuple[DataFrame, DataFrame, int]:
    """(new rows of the log, patches the committer lacks, the new version).

    patches (term, old_list, new_list; one a term) were made on version `base` of the log (version, term, old_list, new_list). Where the log has changed a
    term since, the committer's patch wins and starts from what the log left; patches that then change nothing are left out.
    """
    current = log.agg(F.max("version")).first()[0] or 0
    if base > current:
        raise ValueError(f"version {base} isn't known yet; the log is at {current}")
    since = pull(log, base).select("term", F.col("old_list").alias("_o"), F.col("new_list").alias("_n"), F.lit(True).alias("_since"))
    ours = patches.select("term", "old_list", "new_list")
    rebased = ours.join(since, "term", "left").withColumn("old_list", F.when(F.col("_since"), F.col("_n")).otherwise(F.col("old_list")))
    rows = rebased.where(~F.col("old_list").eqNullSafe(F.col("new_list"))).select(F.lit(current + 1).cast("long").alias("version"), "term", "old_list", "new_list")
    lacking = since.join(ours, "term", "left_anti").select("term", F.col("_o").alias("old_list"), F.col("_n").alias("new_list"))
    return rows, lacking, current + 1


def uploaded(rows: DataFrame) -> DataFrame:
    """A list's state from uploaded lines (status, label, forms parted by |&|): roots with their size and children, and the children."""
    kind = F.when(F.lower("status") == "map", "MapTerm").when(F.lower("status") == "stop", "StopTerm").otherwise("CandidateTerm")
    forms = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce("forms", F.lit("")), r"\|&\|"), lambda x: F.trim(x)), lambda x: (x != "") & (x != F.trim("label")))))
    from ..functions.text import term_size

    r = rows.where(F.trim("label") != "").select(F.trim("label").alias("term"), kind.alias("list"), forms.alias("children"))
    own = r.select("term", term_size("term").alias("size"), "list", F.lit(None).cast("string").alias("root"), F.lit(None).cast("string").alias("parent"), "children")
    below = r.select(F.explode("children").alias("c"), "list", "term").select(F.col("c").alias("term"), term_size("c").alias("size"), "list", F.col("term").alias("root"), F.col("term").alias("parent"), F.array().cast("array<string>").alias("children"))
    return own.unionByName(below)


def changed_since(log: DataFrame, version: int) -> bool:
    return not log.where(F.col("version") > version).isEmpty()


def build_simple_list(counts: DataFrame, stop: DataFrame, wanted: DataFrame, *, size: int = 9, cap: int = 1000) -> DataFrame:
    """A list of (term, n_docs): stop terms, terms voted for, then the terms of most documents as map terms, the next ones as candidates."""
    c = counts.join(stop.select("term").withColumn("_s", F.lit(True)), "term", "left").join(wanted.select("term").withColumn("_w", F.lit(True)), "term", "left")
    free = c.where("_s IS NULL AND _w IS NULL").orderBy(F.desc("n_docs"), "term").limit(cap)
    ranked = free.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n_docs"), "term")))  # cap rows
    room = F.lit(size) - F.lit(wanted.join(counts, "term", "left_semi").count())
    part = lambda df, name: df.select("term", "n_docs", F.lit(name).alias("list"))
    out = part(c.where("_s"), "StopTerm").unionByName(part(c.where("_w AND _s IS NULL"), "MapTerm"))
    return out.unionByName(ranked.select("term", "n_docs", F.when(F.col("r") <= room, "MapTerm").otherwise("CandidateTerm").alias("list")))


def build_term_list(scores: DataFrame, *, mono_share: float = QUOTAS["mono"], inclusion_share: float = QUOTAS["inclusion"], map_size: int = QUOTAS["map"], candidates: int = QUOTAS["candidates"], whole: int = QUOTAS["global"]) -> DataFrame:
    """A list from terms with (term, size, tficf, inclusion, specificity): the best by TF-ICF, single words and phrases by quota, then map terms by inclusion and by specificity, the next ones as candidates."""
    mono = F.col("size") == 1
    n_mono = round(whole * mono_share)
    first = scores.withColumn("kind", mono).withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("tficf", "term"))).where(F.when(mono, F.col("r") <= n_mono).otherwise(F.col("r") <= whole - n_mono))
    n_inc = round(map_size * inclusion_share)
    order = Window.partitionBy("kind")
    ranked = first.withColumn("i", F.row_number().over(order.orderBy(F.desc("inclusion"), "term"))).withColumn("s", F.row_number().over(order.orderBy(F.desc("specificity"), "term")))
    share = F.when(mono, mono_share).otherwise(1 - mono_share)
    is_map = (F.col("i") <= F.round(n_inc * share)) | (F.col("s") <= F.round((map_size - n_inc) * share))
    rest = ranked.withColumn("map", is_map).withColumn("c", F.row_number().over(Window.partitionBy("kind", "map").orderBy("i", "term")))
    kept = rest.where(F.col("map") | (F.col("c") <= F.round(candidates * share)))
    return kept.select("term", "size", F.when(F.col("map"), "MapTerm").otherwise("CandidateTerm").alias("list"))
