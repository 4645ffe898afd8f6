"""Queries for the training-data problems of this package, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import chunking, history, mixing, overlap, packing, splits, tokens
from vigil.llm.components import consolidate
from vigil.llm.documents import once, source_name
from vigil.session import Scratch, table


def _held_before(spark: SparkSession, folder: str) -> DataFrame:
    return history.held_before(table(spark, folder, "validation_records"), "record_id", "selection_round", "sha256", "crop_filename", "perceptual_hash")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose crop a lower selection round already holds."""
    return _held_before(spark, folder).select("record_id")


def p1_round_report(spark: SparkSession, folder: str) -> DataFrame:
    """Records of each round that an earlier round holds."""
    return _held_before(spark, folder).groupBy(F.col("round").alias("selection_round")).agg(F.count(F.lit(1)).alias("n_held"))


def _shares(spark: SparkSession, folder: str) -> dict[str, float]:
    return {r.split: r.target_share for r in table(spark, folder, "split_targets").collect()}  # fixed size


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Source groups and clips whose crops bear two or more splits."""
    return splits.inconsistent(splits.crops(table(spark, folder, "person_crops"), Scratch(spark)), ["source_group", "source_clip"], "old_split")


def p3_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """A split for each crop that keeps groups and clips together."""
    scratch = Scratch(spark)
    rows = splits.crops(table(spark, folder, "person_crops"), scratch)
    return splits.assign(rows, _shares(spark, folder), scratch).select(F.col("row_id").alias("crop_id"), "source_group", "source_clip", "component", "split")


def p3_components(spark: SparkSession, folder: str) -> DataFrame:
    """The component of each crop, named by its smallest key."""
    return splits.crops(table(spark, folder, "person_crops"), Scratch(spark)).where("component not like 'row:%'").select(F.col("row_id").alias("crop_id"), "component")


def p3_kept_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Crops and components of the assignment, and components that it divides or leaves without split."""
    parts = p3_assignment(spark, folder).groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("split").alias("a"), F.max("split").alias("z"))
    return parts.agg(F.sum("n").alias("n_crops"), F.count(F.lit(1)).alias("n_components"), F.count_if(F.col("a").isNull() | (F.col("a") != F.col("z"))).alias("n_divided"))


def p3_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares reached by the assignment against their targets."""
    scratch = Scratch(spark)
    shares = _shares(spark, folder)
    return splits.share_report(splits.assign(splits.crops(table(spark, folder, "person_crops"), scratch), shares, scratch), shares)


def _sides(spark: SparkSession, folder: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    return overlap.sides(table(spark, folder, "public_images"), "image_id", "split", "pixel_hash", "perceptual_hash", scratch, source=F.col("dataset_identity"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of images, one in train and one in val or test, that are the same or nearly so."""
    scratch = Scratch(spark)
    pairs = overlap.overlaps(*_sides(spark, folder, scratch), scratch)
    return pairs.select(F.least("train_id", "held_out_id").alias("image_id_a"), F.greatest("train_id", "held_out_id").alias("image_id_b"))


def p4_overlap_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps per split and dataset of the held-out image."""
    scratch = Scratch(spark)
    return overlap.overlap_report(*_sides(spark, folder, scratch), "source", scratch)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """One group for every image of a candidate pair."""
    return consolidate(table(spark, folder, "candidate_pairs"), "image_a", "image_b").select(F.col("node").alias("image_id"), F.col("group").alias("group_image_id"))


def _limits(spark: SparkSession, folder: str, purpose: str) -> list[tuple[int, int]]:
    """The (limit, overlap) rows of a purpose; a table of fixed size."""
    rows = table(spark, folder, "size_limits").where(F.lower(F.trim("purpose")) == purpose).collect()
    return sorted((r.limit_tokens, r.overlap_tokens or 0) for r in rows)


def _sizes(spark: SparkSession, folder: str, scratch: Scratch) -> DataFrame:
    """(doc_id, source, n_tokens), one row a document."""
    documents = table(spark, folder, "documents").select("doc_id", source_name(F.col("source")).alias("source"), "text")
    return scratch.save(once(scratch.save(tokens.with_sizes(documents, "text", ["doc_id", "source"])), "doc_id", scratch))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark)
    sizes, out = _sizes(spark, folder, scratch), None
    for limit, _ in _limits(spark, folder, "fill"):
        one = packing.pack(sizes, "doc_id", "n_tokens", limit, scratch).select(
            F.lit(limit).alias("limit_tokens"), "container_id", F.col("item_id").alias("doc_id"), "token_start", "n_tokens"
        )
        out = one if out is None else out.unionByName(one)
    return out


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, or parts of oversized ones, of each container, for each fill limit."""
    return _packed(spark, folder)


def p7_fill_report(spark: SparkSession, folder: str) -> DataFrame:
    """Containers and the share of them that is filled, for each fill limit."""
    return packing.fill_report(_packed(spark, folder))


def p7_whole(spark: SparkSession, folder: str) -> DataFrame:
    """For each fill limit and document: whether its parts in the containers are all of it, each token once, and these within the limit."""
    scratch = Scratch(spark)
    packed = scratch.save(_packed(spark, folder))
    held = packed.where("container_id is not null").groupBy("limit_tokens", "container_id").agg((F.sum("n_tokens") <= F.col("limit_tokens")).alias("fits"))
    parts = packed.join(held, ["limit_tokens", "container_id"], "left").groupBy("limit_tokens", "doc_id").agg(
        F.sum("n_tokens").alias("n"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.count(F.lit(1)).alias("k"), F.bool_and(F.coalesce("fits", F.lit(True))).alias("fits")
    )
    sizes = _sizes(spark, folder, scratch).select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("size"))
    once_each = (F.col("n") == F.col("size")) & (F.col("end") == F.col("size")) & (F.col("k") == F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("limit_tokens"))))
    return parts.join(sizes, "doc_id", "full").select("limit_tokens", "doc_id", F.coalesce(once_each, F.lit(False)).alias("whole"), "fits")


def _mixture(spark: SparkSession, folder: str) -> mixing.Mixture:
    scratch = Scratch(spark)
    return mixing.mix(_sizes(spark, folder, scratch), mixing.targets(table(spark, folder, "mix_targets")), scratch)


def p8_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen documents, their repeats and the tokens drawn from them."""
    return mixing.by_document(_mixture(spark, folder).drawn)


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mixture(spark, folder).report


def p8_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The slots of the output shards with the block, and the tokens of documents, that fill each."""
    return _mixture(spark, folder).drawn


def p8_kept_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Per target: documents drawn more often than allowed, blocks drawn twice in a pass, and slots filled twice."""
    scratch = Scratch(spark)
    wanted = mixing.targets(table(spark, folder, "mix_targets"))
    drawn = mixing.mix(_sizes(spark, folder, scratch), wanted, scratch).drawn
    goal = F.broadcast(spark.createDataFrame([(t.source, t.repeats) for t in wanted], "source string, max_repeats int"))  # a table of fixed size
    often = mixing.by_document(drawn).join(goal, "source").groupBy("source").agg(F.count_if(F.col("repeats") > F.col("max_repeats")).alias("n_over"))
    slots = drawn.select("source", "shard", "slot", "pass", "block").distinct()
    twice = lambda keys, name: slots.groupBy("source", *keys).agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.count_if(F.col("n") > 1).alias(name))
    out = goal.join(often, "source", "left").join(twice(["pass", "block"], "n_twice"), "source", "left").join(twice(["shard", "slot"], "n_shared"), "source", "left")
    return out.select("source", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_over", "n_twice", "n_shared")])


def p9_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """For each cut limit and document: the text that its pieces' cores make, and whether pieces keep to the limit and the overlap."""
    scratch = Scratch(spark)
    documents = scratch.save(once(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", scratch))
    limits = _limits(spark, folder, "cut")
    pieces = chunking.split_oversized(documents, "doc_id", "text", limits)
    asked = F.element_at(F.create_map(*[F.lit(x) for pair in limits for x in pair]), F.col("limit_tokens"))
    core = F.struct("piece_no", F.substring(F.col("text"), (F.col("core_start") - F.col("char_start") + 1).cast("int"), F.length("text")).alias("core"))
    made = pieces.groupBy("limit_tokens", "doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(core)), lambda x: x["core"]), "").alias("made"),
        F.bool_and(F.col("n_tokens") <= F.col("limit_tokens")).alias("fits"), F.bool_and((F.col("piece_no") == 0) | (F.col("overlap_tokens") >= asked)).alias("laps"),
    )
    every = documents.select("doc_id", "text", F.explode(F.array(*[F.lit(a) for a, _ in limits])).alias("limit_tokens"))
    return every.join(made, ["limit_tokens", "doc_id"], "left").select("limit_tokens", "doc_id", F.coalesce("made", "text").alias("text"), F.coalesce("fits", F.lit(True)).alias("fits"), F.coalesce("laps", F.lit(True)).alias("laps"))


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of the texts above each cut limit."""
    documents = once(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", Scratch(spark))
    return chunking.split_oversized(documents, "doc_id", "text", _limits(spark, folder, "cut")).select(
        "limit_tokens", "doc_id", "piece_no", "char_start", "core_start", "char_end", "n_tokens", "overlap_tokens", "text"
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_round_report, p3_found, p3_assignment, p3_components, p3_kept_whole, p3_shares, p4_found, p4_overlap_report, p6_found,
    p7_containers, p7_fill_report, p7_whole, p8_documents, p8_shares, p8_blocks, p8_kept_limits, p9_pieces, p9_rebuilt)}

_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_LOW = f"nullif(lower({_STRIP}), '')"
_SPLIT = f"case when {_LOW} in ('valid', 'validation') then 'val' else {_LOW} end"
_DIGEST = f"regexp_replace(lower({_STRIP}), '^sha-?256\\s*[:=\\-]?\\s*(0x)?|^0x', '')".format("sha256")
_NAME = "lower(regexp_replace(crop_filename, '^.*[/\\\\]', ''))"
for _pattern in (
    r"\.rf\.[0-9a-z]+(\.[a-z0-9]{1,5})?$", r"[._](jpe?g|png|bmp|webp|gif|tiff?)$",
    *(r"^\s+|\s+$|^(copy|kopie|copie|copia)( ?\(\d+\))? of ", r"\s+$|[ _]*\(\d+\)$|\s+-\s+(copy|kopie|copie|copia)$|_copy\d*$") * 3,
):
    _NAME = f"regexp_replace({_NAME}, '{_pattern}', '')"

SQL: dict[str, str] = {
    "p1_found": f"""
with r as (
  select record_id, min(selection_round) rnd, min(perceptual_hash) h, min(nullif({_NAME}, '')) name,
    min(case when regexp_matches({_DIGEST}, '^[0-9a-f]{{64}}$') and {_DIGEST} <> repeat(left({_DIGEST}, 1), 64) and {_DIGEST} <> '{history.EMPTY_FILE}' then {_DIGEST} end) digest
  from validation_records where selection_round is not null group by 1)
select record_id from r where
  digest in (select digest from r o where o.rnd < r.rnd and o.digest is not null)
  or name in (select name from r o where o.rnd < r.rnd and o.name is not null)
  or exists (select 1 from r o where o.rnd < r.rnd and bit_count(xor(o.h, r.h)) <= 3)""",
    "p3_found": f"""
with c as (
  select distinct {_LOW.format('source_group')} source_group, regexp_replace({_LOW.format('source_clip')}, '\\.[a-z0-9]{{1,5}}$', '') source_clip,
    {_SPLIT.format('split')} split from person_crops),
k as (select 'source_group' key_field, source_group key_value, split from c union all select 'source_clip', source_clip, split from c)
select key_field, key_value from k where key_value is not null group by 1, 2 having count(distinct split) > 1""",
    "p4_found": f"""
with i as (
  select distinct image_id, {_SPLIT.format('split')} split, {_LOW.format('pixel_hash')} px, perceptual_hash ph from public_images)
select least(a.image_id, b.image_id) image_id_a, greatest(a.image_id, b.image_id) image_id_b
from (select * from i where split = 'train') a join (select * from i where split in ('val', 'test')) b
  on a.px = b.px or bit_count(xor(a.ph, b.ph)) <= 3""",
    "p6_found": """
with recursive e as (
  select image_a a, image_b b from candidate_pairs where image_a is not null and image_b is not null
  union select image_b, image_a from candidate_pairs where image_a is not null and image_b is not null),
reach(a, b) as (select a, a from e union select r.a, e.b from reach r join e on e.a = r.b)
select a image_id, min(b) group_image_id from reach group by 1""",
}
_COMPONENTS = f"""
with recursive c as (
  select crop_id, '0:' || {_LOW.format('source_group')} g, '1:' || regexp_replace({_LOW.format('source_clip')}, '\\.[a-z0-9]{{1,5}}$', '') k
  from person_crops where crop_id is not null qualify row_number() over (partition by crop_id order by g nulls first, k nulls first) = 1),
e as (select g a, k b from c where g is not null and k is not null union select k, g from c where g is not null and k is not null),
reach(a, b) as (select a, a from (select a from e union select g from c where g is not null union select k from c where k is not null) union select r.a, e.b from reach r join e on e.a = r.b),
named as (select a node, min(b) component from reach group by 1),
placed as (select crop_id, component from c left join named on node = coalesce(g, k))"""
SQL["p3_components"] = f"{_COMPONENTS} select crop_id, component from placed where component is not null"
SQL["p3_kept_whole"] = f"{_COMPONENTS} select count(*) n_crops, count(distinct component) + count(*) filter (where component is null) n_components, 0::bigint n_divided from placed"
SQL["p7_whole"] = "select limit_tokens, doc_id, true whole, true fits from (select distinct doc_id from documents where doc_id is not null), (select distinct limit_tokens from size_limits where lower(trim(purpose)) = 'fill')"
SQL["p8_kept_limits"] = "select source, max_repeats, 0::bigint n_over, 0::bigint n_twice, 0::bigint n_shared from mix_targets where target_share > 0"
SQL["p9_rebuilt"] = """select limit_tokens, doc_id, text, true fits, true laps from (select doc_id, min(text) text from documents where doc_id is not null group by 1),
(select distinct limit_tokens from size_limits where lower(trim(purpose)) = 'cut')"""
SQL["p1_round_report"] = f"""with f as ({SQL['p1_found']}), k as (select record_id, min(selection_round) selection_round from validation_records group by 1)
select selection_round, count(*) n_held from f join k using (record_id) group by 1"""
SQL["p4_overlap_report"] = f"""
with i as (
  select distinct image_id, {_SPLIT.format('split')} side, dataset_identity source, {_LOW.format('pixel_hash')} px, perceptual_hash ph from public_images),
p as (select b.image_id, b.side, b.source, coalesce(a.px = b.px, false) same
  from (select * from i where side = 'train') a join (select * from i where side in ('val', 'test')) b on a.px = b.px or bit_count(xor(a.ph, b.ph)) <= 3)
select side, source, count(distinct image_id) n_records, count(*) filter (where same) n_exact_pairs, count(*) filter (where not same) n_near_pairs from p group by 1, 2"""
