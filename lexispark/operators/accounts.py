"""Users, roots, sharing and the administration of the node tree; a change returns the table as it is after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import relations, tree

#: Types of nodes that hold a user's tree. Fixed values of the model.
ROOT, PRIVATE, SHARED, PUBLIC = 1, 20, 21, 22


def users_by(users: DataFrame, **equal) -> DataFrame:
    """Users with given values: name, mail, id, token."""
    for k, v in equal.items():
        users = users.where(F.col(k) == v)
    return users


def with_payload(users: DataFrame, nodes: DataFrame) -> DataFrame:
    """Users and the payload of their node, by user id."""
    own = nodes.where(F.col("typename") == ROOT).select(F.col("user_id").alias("id"), F.col("id").alias("node_id"), "hyperdata")
    return users.join(own, "id", "left")


def root_of(users: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("typename") == ROOT).join(users.where(F.col("username") == name).select(F.col("id").alias("user_id")), "user_id", "left_semi")


def get_or_make_root(users: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """The nodes with a root and its three folders for a user who has none; more than one root is an error. New ids follow from names, so a retry makes the same."""
    have = root_of(users, nodes, name).limit(2).count()
    if have > 1:
        raise ValueError(f"user {name} has more than one root")
    if have:
        return nodes
    user = users.where(F.col("username") == name).select(F.col("id").alias("user_id"))
    parts = F.array(*[F.struct(F.lit(t).alias("typename"), F.lit(n).alias("name")) for t, n in ((ROOT, name), (PRIVATE, "private"), (SHARED, "shared"), (PUBLIC, "public"))])
    new_id = lambda t: F.abs(F.xxhash64(F.lit(name), t))
    rows = user.select("user_id", F.explode(parts).alias("p")).select(new_id(F.col("p.typename")).alias("id"), F.col("p.typename").alias("typename"), "user_id", F.when(F.col("p.typename") != ROOT, new_id(F.lit(ROOT))).alias("parent_id"), F.col("p.name").alias("name"))
    return nodes.unionByName(rows, allowMissingColumns=True)


def rename(nodes: DataFrame, node: int, name: str) -> DataFrame:
    return nodes.withColumn("name", F.when(F.col("id") == node, F.substring(F.lit(name), 1, 255)).otherwise(F.col("name")))


def move(nodes: DataFrame, node: int, parent: int) -> DataFrame:
    return nodes.withColumn("parent_id", F.when(F.col("id") == node, F.lit(parent)).otherwise(F.col("parent_id")))


def update_type(nodes: DataFrame, typename: int, payload: Column) -> DataFrame:
    """All nodes of a type with a payload computed from their row."""
    return nodes.withColumn("hyperdata", F.when(F.col("typename") == typename, payload).otherwise(F.col("hyperdata")))


def update_given(table: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Each field overwritten where a new value is given, kept where it is null."""
    names = [c for c in values.columns if c != key]
    new = values.select(key, *[F.col(c).alias(f"_{c}") for c in names])
    out = table.join(new, key, "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in table.columns])


def two_levels(nodes: DataFrame, root: str | int) -> DataFrame:
    """Children and grandchildren of a node."""
    first = nodes.where(F.col("parent_id") == root)
    second = nodes.join(first.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select(*nodes.columns)
    return first.select(*nodes.columns).unionByName(second)


def below_of_types(nodes: DataFrame, root: DataFrame, kinds: list[int], through: list[int]) -> DataFrame:
    """Nodes of some types below a root, reached through nodes of given types only."""
    seen = nodes.where(F.col("typename").isin([*kinds, *through]) | F.col("parent_id").isNull())
    return tree.descendants(seen, root).where("depth > 0").join(nodes.select("id", "typename"), "id").where(F.col("typename").isin(kinds)).select("id", "depth", "typename")


def share(links: DataFrame, node: int, folder: int, kinds: DataFrame) -> DataFrame:
    """The links with one more from a folder to a node; only folders take links."""
    kind = kinds.where(F.col("id") == folder).select("typename").first()
    if kind is None or kind[0] not in (SHARED, PUBLIC, 210):
        raise ValueError("a node is shared in a shared or public folder or a team")
    row = links.sparkSession.createDataFrame([(folder, node)], "folder long, node long")
    return relations.insert_or_ignore(links, row, ["folder", "node"])


def delete_node(nodes: DataFrame, links: DataFrame, node: int, user: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and links without a node and all below it, by policy: users stay, a team that another user owns is only unlinked."""
    row = nodes.where(F.col("id") == node).first()
    if row is None:
        return nodes, links
    if row["typename"] == ROOT:
        raise ValueError("a user's root can't be deleted")
    if row["typename"] == 210 and row["user_id"] != user:
        return nodes, links.where(F.col("node") != node)
    gone = tree.descendants(nodes, nodes.where(F.col("id") == node).select("id")).select("id")
    return nodes.join(gone, "id", "left_anti"), links.join(gone.withColumnRenamed("id", "node"), "node", "left_anti")


def team(links: DataFrame, nodes: DataFrame, users: DataFrame) -> DataFrame:
    """(folder, username): owners of the folders that link a team."""
    n = nodes.select(F.col("id").alias("folder"), "user_id")
    return links.join(n, "folder", "left").join(users.select(F.col("id").alias("user_id"), "username"), "user_id", "left").select("folder", "username").where("username IS NOT NULL")


def public_folders(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, shared): public folders and what they link, empty ones left out."""
    own = links.groupBy(F.col("folder").alias("id")).agg(F.array_sort(F.collect_set("node")).alias("shared"))
    return nodes.where(F.col("typename") == PUBLIC).join(own, "id").select("id", "shared")


def first_of_type(nodes: DataFrame, typename: int) -> DataFrame:
    """The first node of a type under each parent."""
    return nodes.where(F.col("typename") == typename).withColumn("_r", F.row_number().over(Window.partitionBy("parent_id").orderBy("id"))).where("_r = 1").drop("_r")
