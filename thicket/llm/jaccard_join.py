"""N-gram Jaccard join with a token-group matrix.

Documents are sets of word shingles.  Two link when their Jaccard similarity is
at least ``similarity``.  The method: partition similar documents into small
groups, store each group's token union, bound the overlap of a query document
with that union, and open only groups whose bound reaches what a link needs.

1. ``profiles`` - one scan gives each row the fingerprint of its shingle set;
   equal sets are one node from here on.  The scan also counts shingles that
   several documents of a task share; the most frequent ones (a fixed number)
   form the end of the global token order, by frequency.
2. ``postings`` - a link needs a common token among the first
   ``n - ceil(similarity * n) + 1`` of each set in that order, so only those
   are dealt out by token.  Tokens of one document alone go at once.
3. Groups: documents with the same smallest shared token, dealt into parts of
   about ``GROUP`` members.  Matrix rows (token, group) carry the range of set
   sizes; a (document, group) pair is a candidate when sizes and positions
   allow a link.  A token's rows meet once, in one task.
4. The bound: per group, bit rows of its members and of their union (tokens fold
   into columns) limit the overlap with each query; most candidates end here,
   for a few bytes each.  Groups that are left open: members' whole sets come
   first, then the queries' sets stream by; comparison is exact.
5. A token of more than ``HOT`` documents is not paired out: its documents form
   chains in random parts first, which joins groups of near copies in time
   proportional to their size.  What is then still in several components under
   such a token is opened like in 3 and 4, with parts of components as groups;
   within a component no comparison can change the result.

The result is the classes.  Every link between two classes is found, so they are
exact; links inside a class beyond those that span it are not listed or counted,
as a group of near copies has as many of them as the square of its size.

Texts are known by a 64-bit hash (``tk``); of each set one text is the sample
that later scans look for, so those scans shingle few texts.  Texts whose hashes
collide are all looked at: sets are told apart by their fingerprints.

Defined results: null or empty text (no words): n_shingles 0, linked with
nothing, component_id is the row's own doc_id.  Rows with a null doc_id keep
null unless a linked row has an id.  Repeated rows are each returned.  An empty
table gives an empty result.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .components import components
from .store import Workspace, lean, passes, pick, runtime_filter, sub_batches

WIDTH = 5
SIMILARITY = 80  # percent
#: Tokens that the global order puts last, by frequency: a bound on the broadcast.
FREQUENT = 1 << 18
#: Members of a group, about; and documents of a token above which it is hot.
GROUP = 32
HOT = 128


def need(a, b, percent: int):
    """Least intersection for a link of sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw, offsets = W.buffers(texts)
    starts, ends, wo = W.spans(raw, offsets)
    h = W.hashes(raw, starts, ends, W.LOWER)
    whole = W.shingles(h, width)
    for i in range(len(offsets) - 1):
        a, b = wo[i], wo[i + 1]
        if b - a >= width:
            yield np.unique(whole[a : b - width + 1])
        else:
            yield W.shingles(h[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def fingerprint(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _profile(batches):
    """Rows (doc_id, n, fp, tk); and (token, times) of tokens that several distinct sets of the task share."""
    seen: set[bytes] = set()
    held: list[np.ndarray] = []
    size = 0
    names = ["doc_id", "n", "fp", "tk", "token", "times"]

    def flush():
        nonlocal size
        if not held:
            return None
        token, times = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        size = 0
        many = times > 1
        k = int(many.sum())
        return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.array(token[many].view(np.int64)), pa.array(times[many].astype(np.int64))], names=names)

    for b in sub_batches(batches):
        n, fp = [], []
        for tokens in shingle_sets(b.column(1)):
            n.append(len(tokens))
            key = fingerprint(tokens) if len(tokens) else None
            fp.append(key)
            if key is not None and key not in seen:
                seen.add(key)
                held.append(tokens)
                size += len(tokens)
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), b.column(2), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())], names=names)
        if size > 3_000_000:
            yield flush()
    if (last := flush()) is not None:
        yield last


def _ordered_prefix(tokens: np.ndarray, frequent: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    n = len(tokens)
    keep = n - -(-percent * n // 100) + 1
    if len(frequent):
        at = np.searchsorted(frequent, tokens)
        at[at == len(frequent)] = 0
        late = frequent[at] == tokens
        if late.any():
            return np.concatenate([tokens[~late], tokens[late][np.argsort(place[at[late]], kind="stable")]])[:keep]
    return tokens[:keep]


def _short(key: bytes) -> int:
    """The first 8 bytes of a fingerprint as a signed number: names a document until sets are compared.

    Two sets that share it are proposed together and told apart by fingerprint.
    """
    return int.from_bytes(key[:8], "big", signed=True)


def _postings(frequent, place, counts, percent):
    def run(batches):
        seen: set[bytes] = set()
        texts: set[int] = set()
        for b in sub_batches(batches):
            token, fid, meta = [], [], []
            for tokens in shingle_sets(_unseen(b, texts).column(0)):
                if not len(tokens) or (key := fingerprint(tokens)) in seen:
                    continue
                seen.add(key)
                first = _ordered_prefix(tokens, frequent.value, place.value, percent)
                token.append(first)
                fid.append(np.full(len(first), _short(key)))
                meta.append((np.int64(len(tokens)) << np.int64(32)) + np.arange(len(first)))
            if not token:
                continue
            token, fid = np.concatenate(token), np.concatenate(fid)
            salt = np.zeros(len(token), np.int32)
            if len(frequent.value):
                at = np.searchsorted(frequent.value, token)
                at[at == len(frequent.value)] = 0
                parts = np.where(frequent.value[at] == token, counts.value[at] // HOT + 1, 1)
                mixed = W.mix(fid.view(np.uint64) ^ W.mix(token))
                salt = np.where(parts > 1, 1 + (mixed % parts.astype(np.uint64)).astype(np.int32), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(salt), pa.array(fid), pa.array(np.concatenate(meta))], names=["token", "salt", "fid", "meta"])

    return run


def _chain(batches):
    """Of one task's tokens: rows of tokens with several documents, each with the next document of its part."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got).combine_chunks()
    token, salt, fid, meta = (t.column(c).to_numpy() for c in ("token", "salt", "fid", "meta"))
    order = np.lexsort((fid, meta >> 32, salt, token))
    token, salt, fid, meta = token[order], salt[order], fid[order], meta[order]
    same = np.zeros(len(token), bool)
    same[1:] = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
    again = np.zeros(len(token), bool)  # the same set, seen by several tasks
    again[1:] = same[1:] & (fid[1:] == fid[:-1])
    token, salt, fid, meta = token[~again], salt[~again], fid[~again], meta[~again]
    same = np.zeros(len(token) + 1, bool)
    same[1:-1] = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
    size = np.bincount(np.cumsum(~same[:-1]) - 1)[np.cumsum(~same[:-1]) - 1]
    hot = (size > HOT) | (salt > 0)
    idx = np.flatnonzero(same[:-1] | same[1:] | hot)
    for a in range(0, len(idx), 500_000):
        i = idx[a : a + 500_000]
        follows = same[1:][i] & hot[i]
        yield pa.RecordBatch.from_arrays([pa.array(token[i]), pa.array(hot[i]), pa.array(fid[i]), pa.array(meta[i]), pa.array(fid[np.minimum(i + 1, len(fid) - 1)], mask=~follows)], names=["token", "hot", "fid", "meta", "next"])


def _unseen(b, texts: set[int]):
    """The rows (text, tk) of a batch whose text the task has not met yet."""
    new = np.zeros(b.num_rows, bool)
    for i, k in enumerate(b.column(1).to_pylist()):
        if k not in texts:
            texts.add(k)
            new[i] = True
    return b if new.all() else b.filter(pa.array(new))


def _wanted_sets(b, seen, wanted):
    ok = passes(wanted.value, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
    if not ok.any():
        return
    for tokens in shingle_sets(b.filter(pa.array(ok)).column(0)):
        if len(tokens) and (key := fingerprint(tokens)) not in seen:
            seen.add(key)
            yield key, tokens


def _sets(wanted):
    """Rows (fid, fp, tokens) of the distinct sets of a task that may be wanted."""

    def run(batches):
        seen: set[bytes] = set()
        for b in sub_batches(batches):
            got = list(_wanted_sets(b, seen, wanted))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([_short(k) for k, _ in got], pa.int64()), pa.array([k for k, _ in got], pa.binary()), pa.array([t.tobytes() for _, t in got], pa.binary())], names=["fid", "fp", "tokens"])

    return run


def _proposed(percent: int, most: int = 200_000):
    """Rows (token, gid, fid, meta) of cold tokens, in order of tokens -> candidates (gid, fid): the matrix row of a token and group allows a link.

    A token has ``HOT`` rows at most, so what a task holds is bounded.
    """

    def candidates(token, gid, fid, meta):
        order = np.lexsort((gid, token))
        token, gid, fid, n, pos = token[order], gid[order], fid[order], meta[order] >> 32, meta[order] & (2**31 - 1)
        new_token = np.concatenate([[True], token[1:] != token[:-1]])
        new_row = new_token | np.concatenate([[True], gid[1:] != gid[:-1]])
        first = np.flatnonzero(new_row)
        least_n, most_n, least_pos = np.minimum.reduceat(n, first), np.maximum.reduceat(n, first), np.minimum.reduceat(pos, first)
        alone = np.diff(np.append(first, len(token))) == 1
        row = np.cumsum(new_row) - 1  # of the matrix
        last = np.searchsorted(first, np.append(np.flatnonzero(new_token), len(token)))[np.cumsum(new_token)]  # row after the token's last
        # Each document asks its own row and those after it; its own only if it is not alone there.
        start = row + alone[row]
        width = last - start
        doc = np.repeat(np.arange(len(token)), width)
        ask = np.arange(len(doc)) + np.repeat(start - np.concatenate([[0], np.cumsum(width)[:-1]]), width)
        dn, lo, hi = n[doc], least_n[ask], most_n[ask]
        least = np.maximum(lo, -(-percent * dn // 100))  # the smallest member that may link asks least
        ok = (100 * np.minimum(dn, hi) >= percent * np.maximum(dn, lo)) & (np.minimum(dn - pos[doc], hi - least_pos[ask]) >= -(-percent * (dn + least) // (100 + percent)))
        pairs = np.unique(np.stack([gid[first[ask[ok]]], fid[doc[ok]]]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["gid", "fid"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            size += b.num_rows
            if size >= most:
                cols = [np.concatenate(c) for c in zip(*held)]
                whole = int(np.searchsorted(cols[0], cols[0][-1]))  # the last token may go on
                held, size = [[c[whole:] for c in cols]], size - whole
                if whole:
                    yield candidates(*(c[:whole] for c in cols))
        if size:
            yield candidates(*(np.concatenate(c) for c in zip(*held)))

    return run


def _row(tokens: np.ndarray) -> bytes:
    """A row of the token-group matrix for one set: tokens fold into twice as many columns, or a little more."""
    columns = 1 << max(6, int(2 * len(tokens) - 1).bit_length())
    bits = np.zeros(columns, bool)
    bits[(tokens & np.uint64(columns - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _rows(wanted):
    """Rows (fid, n, bits) of the distinct sets of a task that may be wanted."""

    def run(batches):
        seen: set[bytes] = set()
        for b in sub_batches(batches):
            got = list(_wanted_sets(b, seen, wanted))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([_short(k) for k, _ in got], pa.int64()), pa.array([len(t) for _, t in got], pa.int64()), pa.array([_row(t) for _, t in got], pa.binary())], names=["fid", "n", "bits"])

    return run


def _fold(bits: np.ndarray, columns: int) -> np.ndarray:
    """Matrix rows (one per line) folded to fewer columns; a token keeps its bit."""
    while bits.shape[-1] > columns:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _bound(percent: int):
    """Members of a group, then its queries: those (gid, fid, is_member) that the matrix cannot rule out.

    A query has at least as many tokens outside a union as it has bits outside
    the union's row.
    """

    def run(batches):
        now, members, classes, live = None, [], None, set()

        def flush(out):
            out += [(now[0], fid, True) for fid in live] if now else []
            live.clear()

        for b in batches:
            out = []
            gids, parts, roles, fids, ns = (b.column(i).to_numpy() for i in range(5))
            for i in range(b.num_rows):
                row = np.frombuffer(b.column(5)[i].as_py(), np.uint8)
                if (gids[i], parts[i]) != now:
                    flush(out)
                    now, members, classes = (gids[i], parts[i]), [], None
                if roles[i] == 0:
                    members.append((len(row), ns[i], fids[i], row))
                    continue
                if classes is None:
                    classes = {}
                    for width in {m[0] for m in members}:
                        own = [m for m in members if m[0] == width]
                        rows = np.stack([m[3] for m in own])
                        classes[width] = (np.array([m[1] for m in own]), np.array([m[2] for m in own]), rows, np.bitwise_or.reduce(rows, axis=0))
                n, before = int(ns[i]), len(out)
                for width, (sizes, keys, rows, union) in classes.items():
                    fits = (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)) & (keys != fids[i])
                    if not fits.any():
                        continue
                    common = min(width, len(row))
                    mine = _fold(row, common)
                    if n - int(_ONES[mine & ~_fold(union, common)].sum()) < -(-percent * n // 100):
                        continue
                    over = n - _ONES[mine & ~_fold(rows[fits], common)].sum(axis=1, dtype=np.int64)
                    hit = keys[fits][over >= need(n, sizes[fits], percent)]
                    if len(hit):
                        live.update(hit.tolist())
                        if len(out) == before:
                            out.append((gids[i], fids[i], False))
            if out:
                yield _triples(out)
        out = []
        flush(out)
        if out:
            yield _triples(out)

    return run


def _triples(rows):
    gid, fid, member = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(gid, pa.int64()), pa.array(fid, pa.int64()), pa.array(member)], names=["gid", "fid", "is_member"])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _open(percent: int):
    """Members of a group, then its queries, in order of (group, part, role): links (u, v).

    Documents that links of this group already connect are not compared again, so
    a group gives fewer links than it has documents.
    """

    def run(batches):
        now, members, union, parent = None, {}, None, {}

        def top(x):
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        for b in batches:
            u, v = [], []
            gids, parts, roles = (b.column(i).to_numpy() for i in range(3))
            for i in range(b.num_rows):
                key, tokens = b.column(3)[i].as_py(), np.frombuffer(b.column(4)[i].as_py(), np.uint64)
                if (gids[i], parts[i]) != now:
                    now, members, union = (gids[i], parts[i]), {}, None
                    parent.clear()
                if roles[i] == 0:
                    members[key] = tokens
                    continue
                if not members:
                    continue
                if union is None:
                    union = np.unique(np.concatenate(list(members.values())))
                n = len(tokens)
                if _common(tokens, union) < -(-percent * n // 100):
                    continue
                for other, t in members.items():
                    if 100 * min(n, len(t)) >= percent * max(n, len(t)) and top(other) != top(key) and _common(tokens, t) >= need(n, len(t), percent):
                        parent[top(key)] = top(other)
                        u.append(key)
                        v.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    return run


def _dealt(members: DataFrame, queries: DataFrame, data: DataFrame, columns: list[str], width: int = 256) -> DataFrame:
    """Members and queries of each group side by side; a group with many queries is repeated in several parts."""
    parts = queries.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / width).cast("int").alias("parts"))
    q = queries.join(parts, "gid").select("gid", F.pmod(F.xxhash64("fid"), "parts").cast("int").alias("part"), F.lit(1).alias("role"), "fid")
    m = members.join(parts, "gid").select("gid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), "fid")
    rows = m.union(q).join(data, "fid").select("gid", "part", "role", *columns)
    return rows.repartition("gid", "part").sortWithinPartitions("gid", "part", "role")


def links(texts: DataFrame, samples: DataFrame, members: DataFrame, queries: DataFrame, percent: int, ws: Workspace, name: str) -> DataFrame:
    """Bounds, then opens groups.  members: (gid, fid); queries: (gid, fid), both distinct -> links (u, v)."""
    wanted = lambda *t: runtime_filter(samples.join(t[0].select("fid").union(t[1].select("fid")).distinct(), "fid", "left_semi").select(F.col("tk").alias("k")))
    used = members.join(queries.select("gid").distinct(), "gid", "left_semi")
    # Dealt by fid at once: sets that several tasks met become one there, and the joins below find them in place.
    rows = texts.mapInArrow(lean(_rows(wanted(used, queries))), "fid long, n long, bits binary").repartition("fid").dropDuplicates(["fid", "n", "bits"])
    left = ws.save(_dealt(used, queries, rows, ["fid", "n", "bits"]).mapInArrow(lean(_bound(percent)), "gid long, fid long, is_member boolean"), f"{name}_bound")
    ws.release()
    members, queries = (left.where(w).select("gid", "fid").distinct() for w in ("is_member", "not is_member"))
    sets = texts.mapInArrow(lean(_sets(wanted(members, queries))), "fid long, fp binary, tokens binary").repartition("fid").groupBy("fid", "fp").agg(F.first("tokens").alias("tokens"))
    edges = ws.save(_dealt(members, queries, sets, ["fp", "tokens"]).mapInArrow(lean(_open(percent)), "u binary, v binary").distinct(), name)
    ws.drop(f"{name}_bound")
    return edges


def short(fp: str):
    """``_short`` of a fingerprint column."""
    return F.conv(F.hex(F.expr(f"substr({fp}, 1, 8)")), 16, -10).cast("bigint")


def jaccard_classes(docs: DataFrame, percent: int = SIMILARITY, frequent: int = FREQUENT) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, n_shingles, component_id)``, one row per input row; see the module's text."""
    root, ws = _rooted(docs, percent, frequent)
    # Written, so that the join below meets two plain exchanges and a hot class can be split.
    least = ws.save(root.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    return root.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def _tagged(at: int, names: list[str]):
    """All columns of each row and the fingerprint of its shingle set (null for no words)."""

    def run(batches):
        for b in sub_batches(batches):
            fp = [fingerprint(t) if len(t) else None for t in shingle_sets(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp, pa.binary())], names=[*names, "fp"])

    return run


def keep_one(docs: DataFrame, percent: int = SIMILARITY, frequent: int = FREQUENT) -> DataFrame:
    """The rows of docs without near duplicates: of each class the row with the smallest doc_id stays.

    Rows without words are in no class and stay.  Of rows that repeat the
    smallest doc_id one stays: of those with the chosen set the first in the order
    of all columns that can be ordered.  All columns are kept, whatever their names.
    """
    root, _ = _rooted(docs, percent, frequent)
    # Null ids come last; of one id with several linked texts the first fingerprint stays.
    first = root.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp")).alias("r"))
    chosen = first.select(F.col("r.fp").alias("chosen_fp"), F.col("r.doc_id").alias("chosen_id"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at, of = docs.columns.index("text"), f"c{docs.columns.index('doc_id')}"
    plain = plain.withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    schema = T.StructType([*plain.schema.fields, T.StructField("fp", T.BinaryType())])
    rows = plain.mapInArrow(lean(_tagged(at, plain.columns)), schema)
    kept = rows.where("fp is not null").join(chosen, (F.col("fp") == F.col("chosen_fp")) & F.col(of).cast("long").eqNullSafe(F.col("chosen_id")))
    order = [F.col(f.name) for f in plain.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))] or [F.lit(0)]
    one = kept.withColumn("place", F.row_number().over(Window.partitionBy("chosen_fp", "chosen_id").orderBy(*order))).where("place = 1")
    return one.select(*plain.columns).union(rows.where("fp is null").select(*plain.columns)).toDF(*docs.columns)


def _rooted(docs: DataFrame, percent: int, frequent: int) -> tuple[DataFrame, Workspace]:
    """(doc_id, n, fp, root) of every row; root names its class, null for rows without words."""
    spark: SparkSession = docs.sparkSession
    ws = Workspace(spark, "jaccard")
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tk"))
    texts = pick(docs, "text", "tk")
    seen = ws.save(docs.mapInArrow(lean(_profile), "doc_id long, n long, fp binary, tk long, token long, times long"), "profile")
    profile = seen.where("times is null")
    samples = ws.save(profile.where("fp is not null").groupBy("fp").agg(F.min("tk").alias("tk")).select(short("fp").alias("fid"), "tk"), "samples")
    top = seen.where("times is not null").groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(frequent).toArrow()
    token = top.column("token").to_numpy().view(np.uint64)
    order = np.argsort(token)
    late, place, counts = (spark.sparkContext.broadcast(x) for x in (token[order], np.argsort(np.argsort(-top.column("times").to_numpy()[order], kind="stable")), top.column("times").to_numpy()[order]))
    ws.release()

    dealt = texts.mapInArrow(lean(_postings(late, place, counts, percent)), "token long, salt int, fid long, meta long").repartition("token", "salt")
    posts = dealt.mapInArrow(lean(_chain), "token long, hot boolean, fid long, meta long, next long")
    posts = ws.save(posts.withColumn("key", F.min("token").over(Window.partitionBy("fid"))), "postings")
    del dealt
    ws.release()

    # Groups: the smallest shared token, in parts of about GROUP where more documents have it.
    of = posts.where("token = key").select("fid", "key").distinct()
    many = ws.save(of.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > GROUP).select("key", F.ceil(F.col("k") / GROUP).alias("parts")), "parts")
    gid = F.xxhash64("key", F.pmod(F.xxhash64("fid"), F.coalesce("parts", F.lit(1)))).alias("gid")
    group = ws.save(of.join(many, "key", "left").select("fid", gid), "groups")
    cold = posts.where(~F.col("hot")).select("token", "fid", "meta", "key").join(many, "key", "left").select("token", gid, "fid", "meta")
    asked = cold.repartition("token").sortWithinPartitions("token").mapInArrow(lean(_proposed(percent)), "gid long, fid long")
    chain = posts.where("hot and next is not null").select("fid", "next").join(group.withColumnRenamed("fid", "next"), "next").select("gid", "fid")
    asked = ws.save(asked.union(chain).distinct(), "asked")
    ws.release()
    edges = links(texts, samples, group, asked, percent, ws, "edges")
    ws.drop("groups", "asked", "parts")
    found = components(edges, ws, "cc")
    ws.drop("edges")

    if not posts.where("hot").isEmpty():
        edges = _rest(texts, samples, posts.where("hot"), found, percent, ws)
        found = components(edges, ws, "cd")
        ws.drop("hot_edges")
    ws.drop("postings", "samples")
    root = ws.save(profile.join(found.withColumnRenamed("u", "fp"), "fp", "left").select("doc_id", "n", "fp", F.coalesce("root", "fp").alias("root")), "rooted")
    ws.drop("profile")
    return root, ws


def _size():
    return F.shiftright("meta", 32)


def _rest(texts, samples, posts, found, percent, ws):
    """Links under hot tokens between documents that are not yet in one component, and those found before.

    A row's *reach* is the largest partner its place allows at a first common
    token.  In every linked pair the smaller document reaches its own size at
    least (it is *strong*), so only strong rows look for partners: heavily edited
    copies, whose first places hold tokens of their own, are not paired with each
    other however many they are.
    """
    label = found.select(short("u").alias("fid"), short("root").alias("root"))
    reach = F.expr(f"(({{n}} - {{pos}}) * {100 + percent}) div {percent} - {{n}}".format(n="shiftright(meta, 32)", pos=f"(meta & {2**31 - 1}L)"))
    rows = posts.select("token", "fid", _size().alias("n"), reach.alias("reach")).join(label, "fid", "left")
    rows = ws.save(rows.select("token", "fid", "n", "reach", F.coalesce("root", "fid").alias("root")), "hot")
    kinds = rows.groupBy("token", "root", "n").agg(F.max("reach").alias("reach"), F.count(F.lit(1)).alias("k"))
    times = kinds.groupBy("token", "root").agg(F.sum("k").alias("times"))
    split = times.groupBy("token").agg(F.count(F.lit(1)).alias("roots")).where("roots > 1").select("token")
    kinds = ws.save(kinds.join(times, ["token", "root"]).join(split, "token", "left_semi"), "hot_kinds")
    strong, other = kinds.where("reach >= n").alias("s"), kinds.alias("o")
    pairs = strong.join(other, (F.col("s.token") == F.col("o.token")) & (F.col("s.root") != F.col("o.root")) & (F.col("s.n") <= F.col("o.n")) & (F.col("o.n") <= F.col("s.reach")) & (F.col("s.n") <= F.col("o.reach")))
    # The component with fewer documents under the token asks the other one's groups.
    less = F.struct("s.times", "s.root") < F.struct("o.times", "o.root")
    side = lambda c: (F.when(less, F.col(f"s.{c}")).otherwise(F.col(f"o.{c}")), F.when(less, F.col(f"o.{c}")).otherwise(F.col(f"s.{c}")))
    (root, root2), (n, n2) = side("root"), side("n")
    pairs = ws.save(pairs.select(F.col("s.token").alias("token"), root.alias("root"), n.alias("n"), root2.alias("other"), n2.alias("m")).distinct(), "hot_pairs")
    parts = rows.select("fid", "root").distinct()
    count = parts.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    group = ws.save(parts.join(count, "root").select("fid", F.xxhash64("root", F.pmod(F.xxhash64("fid"), "parts")).alias("gid")), "hot_groups")
    matrix = rows.join(pairs.select("token", F.col("other").alias("root"), F.col("m").alias("n")).distinct(), ["token", "root", "n"], "left_semi").join(group, "fid").groupBy("token", F.col("root").alias("other"), F.col("n").alias("m"), "gid").agg(F.max("reach").alias("allows"))
    ask = rows.join(pairs, ["token", "root", "n"]).where("m <= reach").select("token", "other", "m", "n", "fid")
    asked = ask.join(matrix, ["token", "other", "m"]).where("n <= allows").select("gid", "fid").distinct()
    more = links(texts, samples, group, ws.save(asked, "hot_asked"), percent, ws, "hot_edges")
    ws.drop("hot", "hot_kinds", "hot_pairs", "hot_groups", "hot_asked")
    return more.union(found.select("u", F.col("root").alias("v")))
