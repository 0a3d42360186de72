"""Exact duplicates by deterministic naming: equal texts, and only those, get one integer.

Texts are cut into blocks of a fixed number of characters. All blocks are sorted, and equal ones get one integer name; then neighbouring pairs of
names are sorted and named in the same way, until a text has one name. No step trusts a hash: a name stands for one content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.durable import discard, written, written_at
from latticework.functions.hubs import with_hubs_apart

#: The characters ``[\x20\x09-\x0D]``, which don't count.
BLANKS = " \t\n\x0b\x0c\r"
#: Bits of a name below its level and below its task: up to 63 levels, 2^24 tasks a level, 2^33 names a task.
LEVEL_BITS, TASK_BITS = 57, 33
_NAMED = "_row long, _name long, _pos int, _alone boolean, _border string"


def _columns(batch: pa.Table, names: np.ndarray, alone: np.ndarray, kept: list[str]) -> pa.RecordBatch:
    n = batch.num_rows
    columns = [batch["_row"], pa.array(names, pa.int64()), batch["_pos"], pa.array(alone, pa.bool_()), pa.nulls(n, pa.string()), *[batch[c] for c in kept]]
    return pa.Table.from_arrays(columns, names=["_row", "_name", "_pos", "_alone", "_border", *kept]).combine_chunks().to_batches()[0]


def _borders(found: dict[str, int], sample: pa.Table, kept: list[str]) -> pa.RecordBatch:
    n = len(found)
    columns = [pa.nulls(n, pa.int64()), pa.array(found.values(), pa.int64()), pa.nulls(n, pa.int32()), pa.array([False] * n), pa.array(found.keys(), pa.string()), *[pa.nulls(n, sample.schema.field(c).type) for c in kept]]
    return pa.RecordBatch.from_arrays(columns, names=["_row", "_name", "_pos", "_alone", "_border", *kept])


def _ranked(batches: Iterator[pa.RecordBatch], level: int, kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Names for a task's rows, sorted by ``_h`` and ``_block``.

    ``_alone`` marks a block that surely no other row has. The first and the last hash of a task may go on in its neighbours: their blocks, one each unless
    hashes collide, are told once more as ``_border``. A task holds one batch and one row.
    """
    base = (level << LEVEL_BITS) | (TaskContext.get().partitionId() << TASK_BITS)
    held, held_starts, rank, first, last, head, tail = None, True, 0, None, None, {}, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        h, block = t["_h"].to_numpy(), t["_block"].combine_chunks()
        block = block.chunk(0) if isinstance(block, pa.ChunkedArray) else block
        other_h = h[1:] != h[:-1]
        other = other_h | pc.not_equal(block[1:], block[:-1]).to_numpy(zero_copy_only=False)
        starts, names = np.concatenate([[held_starts], other_h]), base + rank + np.concatenate([[0], np.cumsum(other)])
        first = h[0] if first is None else first
        if h[-1] != last:
            last, tail = h[-1], {}
        new = np.concatenate([[True], other])
        head |= {block[int(i)].as_py(): int(names[i]) for i in np.flatnonzero(new & (h == first))}
        tail |= {block[int(i)].as_py(): int(names[i]) for i in np.flatnonzero(new & (h == last))}
        if len(h) > 1:
            yield _columns(t.slice(0, len(h) - 1), names[:-1], starts[:-1] & starts[1:] & (h[:-1] != first), kept)
        held, held_starts, rank = t.slice(len(h) - 1).combine_chunks().to_batches()[0], bool(starts[-1]), int(names[-1]) - base
    if held is not None:
        one = pa.Table.from_batches([held])
        yield _columns(one, np.array([base + rank]), np.array([False]), kept)
        yield _borders(head | tail, one, kept)


def _names(blocks: DataFrame, level: int) -> tuple[DataFrame, str]:
    """``blocks(_row, _pos, _block, ...)`` with ``_name`` and ``_alone`` in place of ``_block``, and the folder of the table behind it.

    One shuffle: ranges of the block's hash and of the row, so that a block which very many rows hold is dealt over several tasks.
    """
    kept = [c for c in blocks.columns if c not in ("_row", "_pos", "_block")]
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    schema = ", ".join([_NAMED, *[f"`{c}` {kinds[c]}" for c in kept]])
    rows = blocks.withColumn("_h", F.xxhash64("_block")).select("_h", "_block", "_row", "_pos", *kept)
    ranged = rows.repartitionByRange("_h", "_row").sortWithinPartitions("_h", "_block")
    table, at = written_at(ranged.mapInArrow(lambda b: _ranked(b, level, kept), schema))
    border = table.where("_border is not null").select("_border", "_name")
    same = border.join(border.groupBy("_border").agg(F.min("_name").alias("_least")), "_border").where("_name <> _least").select("_name", "_least")
    # At most two blocks a task (and colliding ones): bounded by the number of tasks.
    out = table.where("_row is not null").join(F.broadcast(same), "_name", "left")
    return out.select("_row", "_pos", F.coalesce("_least", "_name").alias("_name"), "_alone", *kept), at


def _cut(text: Column, size: int) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(pieces)


def identities(docs: DataFrame, text_col: str = "text", size: int = 256) -> DataFrame:
    """``(row, n_chars, text_sha256, identity, *other columns)`` of every row of ``docs``: rows have equal ``identity`` iff their texts without ``BLANKS`` are equal.

    n_chars counts the code points of the original text, text_sha256 is the hash of the text without blanks. A null text counts as
    empty; rows with null or repeated columns are rows like any other; an empty table gives an empty result. ``docs`` mustn't have columns named
    ``row``, ``n_chars``, ``text_sha256`` or ``identity`` beside the text (ValueError).
    The text is shuffled once, for its blocks; later levels hold integers, and only of texts whose every block some other block equals.
    """
    others = [c for c in docs.columns if c != text_col]
    if clash := {"row", "n_chars", "text_sha256", "identity"} & set(others):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    plain = F.translate(text, BLANKS, "")
    about = F.struct(F.length(text).cast("long").alias("n_chars"), F.sha2(plain.cast("binary"), 256).alias("text_sha256"), F.struct(*[F.col(c) for c in others]).alias("other") if others else F.lit(None).cast("int").alias("other"))
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), about.alias("_about"), plain.alias("_plain"))
    rows = numbered.select("_row", "_about", F.posexplode(_cut(F.col("_plain"), size)).alias("_pos", "_block"))
    blocks = rows.withColumn("_about", F.when(F.col("_pos") == 0, F.col("_about")))  # once a text
    named, made = _names(blocks, 0)
    fold = lambda t: t.groupBy("_row").agg(F.max("_alone").alias("_alone"), F.sort_array(F.collect_list(F.struct("_pos", "_name"))).getField("_name").alias("_names"))
    texts, texts_at = written_at(named.groupBy("_row").agg(F.first("_about", ignorenulls=True).alias("_about"), F.max("_alone").alias("_alone"), F.sort_array(F.collect_list(F.struct("_pos", "_name"))).getField("_name").alias("_names")))
    discard(spark, [made])
    own = -1 - F.col("_row")  # an identity that no name has
    done, left, level, old = [texts.where("_alone or size(_names) = 1").select("_row", F.when(F.col("_alone"), own).otherwise(F.element_at("_names", 1)).alias("identity"))], texts.where("not _alone and size(_names) > 1").select("_row", "_names"), 0, None
    while not left.isEmpty():
        level += 1
        pairs = F.transform(F.sequence(F.lit(1), F.size("_names"), F.lit(2)), lambda i: F.concat_ws(",", F.element_at("_names", i).cast("string"), F.try_element_at("_names", i + 1).cast("string")))
        named, made = _names(left.select("_row", F.posexplode(pairs).alias("_pos", "_block")), level)
        folded = written(fold(named))
        discard(spark, [made])
        done.append(folded.where("_alone or size(_names) = 1").select("_row", F.when(F.col("_alone"), own).otherwise(F.element_at("_names", 1)).alias("identity")))
        left = folded.where("not _alone and size(_names) > 1").select("_row", "_names")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    out = texts.select("_row", "_about").join(found, "_row")
    return out.select(F.col("_row").alias("row"), F.col("_about.n_chars").alias("n_chars"), F.col("_about.text_sha256").alias("text_sha256"), "identity", *[F.col("_about.other").getField(c).alias(c) for c in others])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 256) -> DataFrame:
    """``(id_col, keep_id, group_size, kept, text_sha256)``, one row for each row of ``docs``.

    Of the rows with equal texts (blanks apart) the one with the most code points stays, then the least id (null ids last), then one of them; ``keep_id`` is its id.
    Null texts count as empty. Other columns of ``docs`` aren't read, whatever their names. A group with a large share of the rows is joined by a broadcast of bounded size.
    """
    ids = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = written(identities(ids, "_text", size))
    order = F.struct((-F.col("n_chars")).alias("c"), F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("row").alias("r"))
    groups = found.where("identity >= 0").groupBy("identity").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_best"))
    groups = groups.withColumn("group_size", F.col("_n"))
    shared = with_hubs_apart(found.where("identity >= 0"), written(groups), "identity", "_n", found.count())
    single = found.where("identity < 0").select(F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return shared.select(F.col("_id").alias(id_col), F.col("_best.i").alias("keep_id"), "group_size", (F.col("_best.r") == F.col("row")).alias("kept"), "text_sha256").unionByName(single)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 256) -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_duplicates`` keeps. The table is written once, so that its rows have fixed numbers."""
    key = "_number"
    while key in docs.columns:
        key += "_"
    marked = written(docs.withColumn(key, F.monotonically_increasing_id()))
    own = F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("i"), F.col(key).alias("k"))
    best = exact_duplicates(marked.select(own.alias(id_col), text_col), id_col, text_col, size).where("kept").select(F.col(id_col)["k"].alias(key))
    return marked.join(best, key, "left_semi").select(*docs.columns)
