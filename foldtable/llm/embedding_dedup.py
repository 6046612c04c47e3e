"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Equal vectors of a label are one class. Classes are packed into blocks, and every pair of blocks
of a label is a tile: its cosines are bounded from int8 products and each vector's own
quantisation error, and only pairs whose bound reaches the threshold are computed in double
precision. A tile returns sums of links and a spanning forest, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import connected_components, local_roots

THRESHOLD = 0.98
#: Rows on a side of a tile, whose products are in memory at once.
TILE = 1024


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two, which changes no digit, so that squares of very large or small components neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0))
    return np.ldexp(x, -exponent[:, None])


def _quantised(x: np.ndarray):
    """Unit vectors as int8 codes, scales, and the lengths of the codes and of what they miss."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype("int8")
    close = codes * scale[:, None]
    return codes, scale, np.linalg.norm(close, axis=1), np.linalg.norm(unit - close, axis=1)


def _links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool, piece_bytes: int = 32 << 20):
    """Index pairs of rows of x and y whose cosine in double precision reaches the threshold.

    With unit vectors u = c + e of code part c and error e, u.v = c.c' + c.e' + e.v and the last two
    are at most |c||e'| + |e|. Codes are multiplied as float32, in pieces whose sums are exact.
    """
    (cx, sx, lx, ex), (cy, sy, _, ey) = _quantised(x), _quantised(y)
    # A sum of 1024 products of codes is below 2^24, up to which float32 holds every integer.
    product = sum((cx[:, k : k + 1024].astype("float32") @ cy[:, k : k + 1024].astype("float32").T).astype("float64") for k in range(0, cx.shape[1], 1024))
    bound = product * sx[:, None] * sy[None, :] + lx[:, None] * ey[None, :] + ex[:, None]
    i, j = np.nonzero(bound >= threshold - 1e-9)
    if same:
        i, j = i[i < j], j[i < j]
    piece = max(1, piece_bytes // (8 * x.shape[1]))
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    near = [np.einsum("ij,ij->i", x[i[k : k + piece]], y[j[k : k + piece]]) / (nx[i[k : k + piece]] * ny[j[k : k + piece]]) >= threshold for k in range(0, len(i), piece)]
    near = np.concatenate(near) if near else np.zeros(0, bool)
    return i[near], j[near]


def _pack(key, table):
    values = table["embedding"].combine_chunks().flatten().to_numpy().astype("<f8")
    packed = {"label": key[0].as_py(), "dim": key[1].as_py(), "block": key[2].as_py(), "blocks": table["blocks"][0].as_py()}
    ids, copies = table["class_id"].to_numpy().astype("<i8"), table["copies"].to_numpy().astype("<i8")
    packed |= {"ids": ids.tobytes(), "copies": copies.tobytes(), "vectors": values.tobytes()}
    return pa.Table.from_pylist([packed], PACKED)


PACKED = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("block", pa.int32()), ("blocks", pa.int32()), ("ids", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary())])
PACKED_DDL = "label string, dim int, block int, blocks int, ids binary, copies binary, vectors binary"


def _all_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool, side: int = TILE):
    """_links of whole blocks, tile by tile."""
    found = [np.zeros((2, 0), "int64")]
    for a in range(0, len(x), side):
        for b in range(a if same else 0, len(y), side):
            i, j = _links(x[a : a + side], y[b : b + side], threshold, same and a == b)
            found.append(np.stack([i + a, j + b]))
    return np.concatenate(found, axis=1)


def _tiles(threshold: float):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda name, kind, k=k: np.frombuffer(batch.column(name)[k].as_py(), kind)
                dim, same = batch.column("dim")[k].as_py(), batch.column("i")[k] == batch.column("j")[k]
                ids, copies, x = get("ids", "<i8"), get("copies", "<i8"), _scaled(get("vectors", "<f8").reshape(-1, dim))
                if same:
                    i, j = _all_links(x, x, threshold, True)
                    both, n = (ids, copies), len(ids)
                else:
                    i, j = _all_links(x, _scaled(get("other_vectors", "<f8").reshape(-1, dim)), threshold, False)
                    j = j + len(ids)
                    both = (np.concatenate([ids, get("other_ids", "<i8")]), np.concatenate([copies, get("other_copies", "<i8")]))
                    n = len(both[0])
                links = np.bincount(i, both[1][j], n) + np.bincount(j, both[1][i], n)
                root = local_roots(n, i, j)
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(both[0][at]), pa.array(links[at].astype("int64")), pa.array(both[0][root[at]])], ["class_id", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block_bytes: int = 4 << 20) -> DataFrame:
    """vec_id, n_links and component_id of every row of vectors (vec_id, embedding, label).

    Vectors link when their labels are equal and not null and their cosine in double precision
    is at least `threshold`. Null and zero vectors, and those with null or non-finite components,
    link with nothing, nor do vectors of different lengths. Repeated rows are vectors of their
    own. component_id is the smallest vec_id that links reach, null if none has one. An empty
    table gives no rows. Copies of one vector form a class, so a vector on a third of all rows
    is compared once; a label on a third of all rows has more blocks than others, all of one size: about
    `block_bytes` of vectors, which are compared in tiles of 1024 rows. A block travels once for each block of its
    label, so larger blocks are fewer copies.
    """
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding", F.coalesce(usable, F.lit(False)).alias("usable"))
    keys = [F.xxhash64("label", "embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding", "label").alias("k2")]
    rows = stage(rows.select("*", *keys), "emb-rows")
    equal = rows.where("usable").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = stage(equal.withColumn("dim", F.size("embedding")).withColumn("class_id", F.monotonically_increasing_id()), "emb-classes")

    blocks = stage(classes.groupBy("label", "dim").agg(F.ceil(F.count("*") * F.col("dim") * 8 / block_bytes).cast("int").alias("blocks")), "emb-blocks")
    dealt = classes.join(blocks, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    packed = stage(dealt.select("label", "dim", "block", "blocks", "class_id", "copies", "embedding").groupBy("label", "dim", "block").applyInArrow(_pack, PACKED_DDL), "emb-packed")
    left = packed.select("*", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = packed.where("block > 0").select(
        "label", "dim", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("block").alias("j"),
        F.col("ids").alias("other_ids"), F.col("copies").alias("other_copies"), F.col("vectors").alias("other_vectors"),
    )
    tiles = left.join(right, ["label", "dim", "i", "j"], "left")
    found = stage(tiles.mapInArrow(_tiles(threshold), "class_id long, links long, root long"), "emb-found")

    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    members = connected_components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "class_id")
    slim = classes.drop("embedding", "label", "dim")
    joined = slim.join(links, "class_id", "left").join(members, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    joined = stage(joined, "emb-joined")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stage(joined.join(least, "component").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "emb-named")
    own = rows.select("vec_id", F.when(F.col("usable"), F.col("k1")).alias("k1"), F.when(F.col("usable"), F.col("k2")).alias("k2"))
    return own.join(named, ["k1", "k2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def group_vectors(spark, vectors: DataFrame) -> DataFrame:
    """Links and component of every vector, and whether it is the one its component keeps."""
    return near_duplicates(vectors).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
