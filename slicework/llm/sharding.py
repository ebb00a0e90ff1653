"""Hierarchical weighted hash tree: rows descend region, rack and shard levels by weighted draws.

At each level every child of the chosen node draws ``-ln(u) / weight`` with ``u`` hashed from the
row's key and the child's name, and the smallest draw wins. A child is chosen in proportion to its
weight, and a change of weights moves rows only into or out of the subtrees whose weights changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slicework.llm.shared import materialize

#: Most numbering buckets per shard; bounds the table of offsets that is broadcast.
MAX_BUCKETS = 4096
#: Rows of one shard and bucket that are numbered together, on average.
ROWS_PER_BUCKET = 500


@dataclass(frozen=True)
class Leaf:
    shard: int
    rack: str
    region: str
    weight: float = 1.0


def default_tree(n_shards: int, planned: int = 16, per_rack: int = 4, racks_per_region: int = 2) -> list[Leaf]:
    """The planned shards fill racks and regions; each further one stands in a region of its own.

    So one more shard adds weight to one new subtree whose only leaf it is, and takes rows only
    into itself. Re-planning (another ``planned``) is a migration, not a growth.
    """
    leaves = []
    for s in range(n_shards):
        if s < planned:
            rack = s // per_rack
            leaves.append(Leaf(s, f"k{rack}", f"r{rack // racks_per_region}"))
        else:
            leaves.append(Leaf(s, f"x{s}", f"x{s}"))
    return leaves


def uniform(key: Column, salt: str) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of salt and key."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(salt + "/"), key)), 1, 13), 16, 10).cast("bigint")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def draw(key: Column, node: str, weight: float) -> Column:
    return -F.ln(uniform(key, node)) / F.lit(float(weight))


def descend(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key, as one expression: winner of the regions, then of its racks, then of its shards."""

    def winner(children: dict[str, tuple[float, Column]]) -> Column:
        if len(children) == 1:
            return next(iter(children.values()))[1]
        return F.least(*[F.struct(draw(key, n, w).alias("d"), c.alias("c")) for n, (w, c) in children.items()])["c"]

    def branch(chosen: Column, options: dict[str, Column]) -> Column:
        out = None
        for name, c in options.items():
            out = F.when(chosen == name, c) if out is None else out.when(chosen == name, c)
        return out

    regions: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in leaves:
        regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    total = lambda ls: sum(x.weight for x in ls)
    region = winner({f"region:{r}": (sum(map(total, racks.values())), F.lit(r)) for r, racks in regions.items()})
    rack = branch(region, {r: winner({f"rack:{k}": (total(ls), F.lit(k)) for k, ls in racks.items()}) for r, racks in regions.items()})
    shards = {k: winner({f"shard:{x.shard}": (x.weight, F.lit(x.shard)) for x in ls}) for racks in regions.values() for k, ls in racks.items()}
    return branch(rack, shards)


def assign_shards(docs: DataFrame, leaves: list[Leaf], key: str = "doc_id", out: str = "shard") -> DataFrame:
    """``docs`` with the column ``out``. A null key counts as the text ``null``; equal keys go together."""
    return docs.withColumn(out, descend(F.coalesce(F.col(key).cast("string"), F.lit("null")), leaves))


def number_slots(rows: DataFrame, n_rows: int, shard: str = "shard", order: tuple[str, ...] = ("doc_id",), out: str = "slot") -> DataFrame:
    """``rows`` with gapless numbers from 0 in each shard, without bringing a shard to one task.

    Rows are dealt to hash buckets, counted per shard and bucket, and numbered inside each; the
    buckets before give the offset. Repeated rows get different numbers.
    """
    n = max(1, min(MAX_BUCKETS, -(-n_rows // (ROWS_PER_BUCKET * 16))))
    key = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in order])
    dealt = rows.withColumn("__bucket", F.floor(uniform(key, "slot") * n).cast("int"))
    counts = dealt.groupBy(shard, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(shard).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(shard, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = W.partitionBy(shard, "__bucket").orderBy(*order)
    numbered = dealt.withColumn("__rank", F.row_number().over(inside))
    joined = numbered.join(F.broadcast(offsets), [shard, "__bucket"])  # at most MAX_BUCKETS rows a shard
    return joined.withColumn(out, (F.col("__before") + F.col("__rank") - 1).cast("long")).drop("__bucket", "__before", "__rank")


def op3_hash_tree(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """One row per document: its shard now and with one more shard, and its slot in the shard (law ``key``).

    The tree is planned for 16 shards, or for ``n_shards`` if that is fewer; more shards are growth. Null text: size 1 and the CRC of no bytes. Copies of a row go to one shard and get slots of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    planned = min(16, n_shards)
    placed = assign_shards(slim, default_tree(n_shards, planned))
    placed = assign_shards(placed, default_tree(n_shards + 1, planned), out="grown_shard")
    placed = materialize(placed, "shards")
    out = number_slots(placed, placed.count(), order=("doc_id", "text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def oracle(n_shards: int = 16) -> str:
    """The same in DuckDB's SQL, for the planned number of shards."""
    u = lambda salt: f"((('0x'||substr(md5('{salt}/'||k),1,13))::bigint + 0.5::double) / 4503599627370496.0::double)"

    def winner(children: list[tuple[str, float, str]]) -> str:
        if len(children) == 1:
            return f"'{children[0][2]}'"
        draws = ", ".join(f"{{'d': -ln({u(node)}) / {float(w)}::double, 'c': '{c}'}}" for node, w, c in children)
        return f"list_min([{draws}]).c"

    def levels(n: int, name: str) -> tuple[str, str, str]:
        tree: dict[str, dict[str, list[Leaf]]] = {}
        for leaf in default_tree(n, min(16, n_shards)):
            tree.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
        regions = winner([(f"region:{r}", sum(x.weight for ls in ks.values() for x in ls), r) for r, ks in tree.items()])
        racks = " ".join(f"when '{r}' then {winner([(f'rack:{k}', sum(x.weight for x in ls), k) for k, ls in ks.items()])}" for r, ks in tree.items())
        shards = " ".join(f"when '{k}' then {winner([(f'shard:{x.shard}', x.weight, str(x.shard)) for x in ls])}" for ks in tree.values() for k, ls in ks.items())
        return f"{regions} as {name}_r", f"case {name}_r {racks} end as {name}_k", f"(case {name}_k {shards} end)::int as {name}"

    now, grown = levels(n_shards, "shard"), levels(n_shards + 1, "grown_shard")
    rows_per = ROWS_PER_BUCKET * 16
    slot_key = "coalesce(doc_id::varchar,'null')||'/'||text_crc32||'/'||size"
    return f"""
with tbl as (select [list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end) for i in range(256)] as t),
hexed as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
slim as (select doc_id, coalesce(doc_id::varchar, 'null') as k, (len(x) // 2 + 1)::bigint as size, xor(4294967295::bigint, list_reduce(list_concat([4294967295::bigint], [('0x' || substr(x, (2 * i + 1)::bigint, 2))::bigint for i in range(len(x) // 2)]), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) as text_crc32 from hexed, tbl),
a as (select *, {now[0]}, {grown[0]} from slim), b as (select *, {now[1]}, {grown[1]} from a), c as (select *, {now[2]}, {grown[2]} from b),
n as (select greatest(1, least({MAX_BUCKETS}, ceil(count(*) / {float(rows_per)}::double)))::bigint as buckets from documents),
d as (select *, floor({u("slot").replace("||k)", f"||{slot_key})")} * buckets)::int as bucket from c, n)
select doc_id, size, text_crc32, 'key' as law, shard, (row_number() over (partition by shard order by bucket, doc_id, text_crc32, size) - 1)::bigint as slot, grown_shard from d
"""
