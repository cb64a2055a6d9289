"""WARC archives and their Merkle fixity audit.

``archive`` turns pages into WARC/1.1 response records with offsets in archives of ``RECORDS`` records.
``tree`` hashes each record with its offset range into a leaf and every ``FANOUT`` neighbouring nodes into their
parent, up to one root for each archive; a node also covers the byte range of its children and holds them, so that an archive's tree
is one row. ``audit`` compares the roots of two replicas, reads the trees of archives whose roots differ, and in these opens only
nodes that differ, down to the damaged records.

Everything is DataFrame expressions; all groups are bounded (FANOUT children; the records of an archive), whatever the
number of pages, and a page that holds many bytes is one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import drop, n_parts, table, written

RECORDS = 512
#: Archives whose records are numbered together, on average.
SHELF = 2
FANOUT = 8
CRLF = "\r\n"
#: The capture date of records: fixed, so that the same pages give the same bytes.
DATE = "2024-01-01T00:00:00Z"


def record_bytes(url: Column, html: Column) -> Column:
    """The WARC response record of a page; nulls are empty; line ends in the url are dropped."""
    url = F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"[\r\n]", "")
    body = F.encode(F.coalesce(html.cast("string"), F.lit("")), "UTF-8")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2))
    digest = F.concat(F.lit("sha1:"), F.sha1(body))
    ident = F.md5(F.concat(F.encode(url, "UTF-8"), body))
    urn = F.concat_ws("-", *[F.substring(ident, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: response{CRLF}WARC-Target-URI: "), url,
        F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}WARC-Record-ID: <urn:uuid:"), urn,
        F.lit(f">{CRLF}WARC-Payload-Digest: "), digest,
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), (F.octet_length(F.encode(http, "UTF-8")) + F.octet_length(body)).cast("string"),
        F.lit(CRLF * 2), http,
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit(CRLF * 2), "UTF-8"))


def archive(pages: DataFrame, records: int = RECORDS) -> DataFrame:
    """Records of all ``pages`` (page_id, url, html): archive, record_no, page_id, offset, length, digest, record.

    A page's shelf is a hash of its id, url and content, so that no host or id range fills one; a shelf's records in order of
    page_id, url and digest are cut into archives of ``records``. Repeated rows are records of their own (they share a shelf, and fill as
    many archives as they need); null ids come first. An empty table gives no record.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), record_bytes(F.col("url"), F.col("html")).alias("record"))
    shelves = max(1, -(-pages.select(F.lit(1)).count() // (records * SHELF)))
    rows = rows.withColumn("digest", F.sha2("record", 256)).withColumn("length", F.octet_length("record").cast("bigint"))
    rows = rows.withColumn("shelf", F.pmod(F.xxhash64("page_id", "url", "digest"), F.lit(shelves))).repartition(n_parts(pages.sparkSession), "shelf")
    w = W.partitionBy("shelf").orderBy("page_id", "url", "digest")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("k", F.row_number().over(w) - 1).withColumn("total", F.coalesce(F.sum("length").over(before), F.lit(0)))
    rows = rows.withColumn("record_no", F.col("k") % records)
    base = F.last(F.when(F.col("record_no") == 0, F.col("total")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    number = F.col("shelf") + F.lit(shelves) * F.floor(F.col("k") / records)
    return rows.select(number.cast("bigint").alias("archive"), "record_no", "page_id", (F.col("total") - base).cast("bigint").alias("offset"), "length", "digest", "record")


def leaf_hash(offset: Column, length: Column, digest: Column) -> Column:
    return F.sha2(F.encode(F.concat_ws(":", F.lit("leaf"), offset.cast("string"), length.cast("string"), digest), "UTF-8"), 256)


def leaves(replica: DataFrame) -> DataFrame:
    """One row a record of the replica (archive, record_no, offset, length, record): archive, node = record_no, begin, end, hash, from the record's bytes."""
    hashed = leaf_hash(F.col("offset"), F.col("length"), F.sha2("record", 256))
    return replica.select("archive", F.col("record_no").cast("int").alias("node"), F.col("offset").alias("begin"), (F.col("offset") + F.col("length")).alias("end"), hashed.alias("hash"))


def depth(records: int = RECORDS) -> int:
    """Levels above the leaves until ``records`` of them have one root."""
    k = 1
    while FANOUT**k < records:
        k += 1
    return k


def tree(leaf_rows: DataFrame, levels: int) -> DataFrame:
    """A row for each root: archive, node, begin, end, hash, children; ``children`` are structs of the same fields, down to the leaves.
    A parent hashes its children's hashes in order. One shuffle, on the archive."""
    level = leaf_rows.repartition(n_parts(leaf_rows.sparkSession), "archive")
    for k in range(levels):
        child = F.struct("node", "begin", "end", "hash", *(["children"] if k else []))
        level = level.groupBy("archive", F.floor(F.col("node") / FANOUT).cast("int").alias("parent")).agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.array_sort(F.collect_list(child)).alias("children"))
        hashes = F.array_join(F.transform("children", lambda x: x["hash"]), ",")
        level = level.select("archive", F.col("parent").alias("node"), "begin", "end", F.sha2(F.concat(F.lit("node:"), hashes), 256).alias("hash"), "children")
    return level


def audit(a: DataFrame, b: DataFrame, levels: int) -> DataFrame:
    """Leaves of the trees ``a`` and ``b`` that differ (archive, node, begin, end, hash_a, hash_b); one that only one
    replica has counts as different.

    Roots are compared for all archives (of the other columns nothing is read); the trees of those that differ are brought together by
    archive once, and below nodes that agree nothing is opened."""
    sides = [t.select("archive", "node", F.col("hash").alias(h)) for t, h in ((a, "ha"), (b, "hb"))]
    roots = sides[0].join(sides[1], ["archive", "node"], "full").filter(~F.col("ha").eqNullSafe(F.col("hb"))).select("archive").distinct()
    open_ = [t.join(roots, "archive", "left_semi").select("archive", "children", F.lit(n).alias("side")) for t, n in ((a, "a"), (b, "b"))]
    level = open_[0].unionByName(open_[1]).repartition(n_parts(a.sparkSession), "archive")
    kids = level.select("archive", "side", F.explode("children").alias("x"))
    for k in range(levels):
        pick = lambda n: F.first(F.when(F.col("side") == n, F.col("x")), ignorenulls=True).alias(n)
        pair = kids.groupBy("archive", F.col("x.node").alias("node")).agg(pick("a"), pick("b")).filter(~F.col("a.hash").eqNullSafe(F.col("b.hash")))
        if k < levels - 1:
            both = F.array(*[F.struct(F.lit(n).alias("side"), F.col(n)["children"].alias("children")) for n in ("a", "b")])
            kids = pair.select("archive", F.explode(both).alias("y")).select("archive", "y.side", F.explode("y.children").alias("x"))
    return pair.select("archive", "node", F.coalesce("a.begin", "b.begin").alias("begin"), F.coalesce("a.end", "b.end").alias("end"), F.col("a.hash").alias("hash_a"), F.col("b.hash").alias("hash_b"))


def damaged(records: DataFrame, one_in: int = 500) -> DataFrame:
    """A replica in which about one record in ``one_in`` (by a hash of its place and content) has one byte changed: the
    fault that the query's audit has to find."""
    r, n = F.col("record"), F.col("length").cast("int")
    at = F.pmod(F.xxhash64("archive", "record_no", F.lit(5)), n).cast("int")
    byte = F.hex(F.substring(r, at + 1, F.lit(1)))
    other = F.unhex(F.lpad(F.hex(F.conv(byte, 16, 10).cast("int").bitwiseXOR(F.lit(1))), 2, "0"))
    hit = F.pmod(F.xxhash64("archive", "record_no", F.lit(11)), F.lit(one_in)) == 0
    changed = F.concat(F.substring(r, F.lit(1), at), other, F.substring(r, at + 2, n))
    return records.withColumn("record", F.when(hit, changed).otherwise(r))


def op6_merkle_fixity(spark, sf_dir: str) -> DataFrame:
    """Every page's place in the archives, its leaf hash and whether the second replica's record is intact."""
    first = written(archive(table(spark, sf_dir, "pages")), "warc")
    a = first.select("page_id", "length", "archive", "record_no", "offset", leaf_hash(F.col("offset"), F.col("length"), F.col("digest")).alias("hash"))
    leaf_a = a.select("archive", F.col("record_no").cast("int").alias("node"), F.col("offset").alias("begin"), (F.col("offset") + F.col("length")).alias("end"), "hash")
    levels = depth()
    tree_a, tree_b = written(tree(leaf_a, levels), "tree-a"), written(tree(leaves(damaged(first)), levels), "tree-b")
    found = written(audit(tree_a, tree_b, levels), "damaged").select("archive", F.col("node").alias("record_no"), F.lit(True).alias("damaged"))
    drop(tree_a, tree_b)
    out = a.join(found, ["archive", "record_no"], "left")
    return out.select("page_id", "archive", "record_no", F.col("offset").alias("begin"), "length", "hash", F.coalesce("damaged", F.lit(False)).alias("damaged"))
