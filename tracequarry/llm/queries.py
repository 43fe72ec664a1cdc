"""The queries of the thirteen operators, as their contracts fix them, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.llm import attention, audit, chat, fingerprints, innerproducts, lattice, mixing, neardup, packing, quality, repeats, sharding, spelling
from tracequarry.llm._store import crc, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, percent=80)


OP2_SQL = r"""
with recursive words as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select r, doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 4 then [array_to_string(w, ' ')]
         else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s
  from words),
elements as (select r, len(s) as n, unnest(s) as g from sets),
links as (
  select a.r as x, b.r as y from elements a join elements b on a.g = b.g and a.r <> b.r
  group by a.r, b.r, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach as (select r, r as other from sets union select reach.r, y from reach join links on other = x),
least as (select reach.r, min(o.doc_id) as component_id from reach join sets o on o.r = other group by reach.r)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id is not distinct from component_id as kept
from sets join least using (r)
"""


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lattice.scored(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), folds=5, fold=1)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = stored(quality.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "ledger")
    base = F.col("failed").bitwiseAND(quality.mask(quality.POLICIES[1])) != 0
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), quality.kept(2).alias("kept"), "failed")


OP4_SQL = r"""
with words as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
wins as (
  select r, unnest(range(1, greatest(len(w) - 3, 1))) as p, w from words),
keyed as (select r, p, list_aggregate(w[p:p + 4], 'string_agg', ' ') as k from wins),
twice as (select r, p, count(*) over (partition by r, k) as c from keyed),
reach as (select r, least(5, coalesce(lead(p) over (partition by r order by p) - p, 5)) as x from twice where c > 1),
rep as (select r, sum(x)::bigint as n_repeat_words from reach group by r),
counts as (
  select doc_id, len(w)::bigint as n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
         len(regexp_extract_all(text, '\p{Lu}')) as n_capitals, len(regexp_extract_all(text, '!')) as n_exclamations,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from words left join rep using (r)),
lined as (select *, len(lines) as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines from counts),
bits as (
  select *, case when n_words < 10 then 1 else 0 end
          + case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end
          + case when 10 * n_symbols > 3 * n_words then 4 else 0 end
          + case when n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines then 8 else 0 end
          + case when n_words >= 10 and 100 * n_capitals > 60 * word_chars then 16 else 0 end
          + case when n_words >= 10 and 2 * n_exclamations > n_words then 32 else 0 end
          + case when n_words >= 10 and (word_chars < 2 * n_words or word_chars > 30 * n_words) then 64 else 0 end as failed
  from lined)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed & 3 <> 0 as base_failed, failed = 0 as kept, failed::int as failed
from bits
"""


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    trees = stored(chat.as_trees(rows.unionByName(own)), "chat-trees")
    out = chat.formatted(trees).withColumn("turns", chat.turns_of(F.col("formatted"))).withColumn("loss", F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_spans")), ""))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc as (
  select *, length(regexp_replace(role, '([<\[\\])', '\1\\', 'g')) + length(regexp_replace(text, '([<\[\\])', '\1\\', 'g')) + 23 as n
  from turns),
told as (
  select conv_id, count(*)::bigint as n_turns, sum(n)::bigint as formatted_chars,
         string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as t,
         coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as l
  from esc group by conv_id)
select conv_id, n_turns, sha256(t) as turns_sha256, length(l)::bigint as loss_chars, sha256(l) as loss_sha256, formatted_chars
from told
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end=2)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=35, words_only=True)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
with words as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select r, i, md5(array_to_string(w[i:i + 34], ' ')) as h from (select r, w, unnest(range(1, len(w) - 33)) as i from words)),
repeated as (select r, i from (select *, count(*) over (partition by h) as c from windows) where c > 1),
gone as (select r, list(distinct k) as ks from (select r, unnest(range(i, i + 35)) as k from repeated) group by r),
cut as (select doc_id, w, coalesce(ks, []::bigint[]) as ks from words left join gone using (r))
select doc_id, len(w)::bigint as n_words, len(ks)::bigint as n_removed,
       sha256(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: not list_contains(ks, p[2])), lambda p: p[1]), ' ')) as kept_sha256
from cut
"""


def op8_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "quality")
    held_out = F.pmod(crc(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2
    model = attention.learned(documents, labels.where(~held_out), label="quality")
    return attention.scored(documents, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    plan = mixing.mix_plan(documents)
    sized = documents.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    out = mixing.with_repetitions(sized, plan)
    return out.select("doc_id", "size", "source_size", "target", (F.col("repetitions") * F.col("size")).alias("taken"))


OP9_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('9:' || coalesce(doc_id::varchar, '')) as draw
  from documents),
sources as (
  select source, sum(size)::bigint as source_size,
         [5, 2, 1][((row_number() over (order by source nulls last)) - 1) % 3 + 1] as weight
  from sized group by source),
filled as (
  select *, 2.0::double * source_size as cap,
         coalesce(sum(2.0::double * source_size) over lower, 0) as used,
         coalesce(sum(weight) over lower, 0) as used_weight,
         sum(source_size) over () as all_size, sum(weight) over () as all_weight
  from sources
  window lower as (order by (2.0::double * source_size) / weight, source nulls last rows between unbounded preceding and 1 preceding)),
levels as (select *, (1.5::double * all_size - used) / (all_weight - used_weight) as level from filled),
targets as (
  select source, source_size,
         case when cap <= weight * level then cap
              else weight * (select l.level from levels l where not l.cap <= l.weight * l.level order by l.used_weight limit 1) end as target
  from levels),
plan as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole,
         target - (case when source_size > 0 then floor(target / source_size) else 0 end)::bigint * source_size as rest
  from targets),
drawn as (select source, draw, sum(size)::bigint as own from sized group by source, draw),
running as (
  select d.*, p.rest, sum(own) over (partition by d.source order by draw) as upto
  from drawn d join plan p on d.source is not distinct from p.source),
short as (select source, rest - coalesce(max(upto) filter (where upto <= rest), 0) as short from running group by source, rest),
extra as (
  select r.source, arg_min(r.draw, (abs(own - short), r.draw)) as draw
  from running r join short s on r.source is not distinct from s.source
  where upto > rest and abs(own - short) < short group by r.source)
select s.doc_id, s.size, p.source_size, p.target,
       (s.size * (p.whole + case when r.upto <= p.rest or e.draw is not null then 1 else 0 end))::bigint as taken
from sized s
join plan p on s.source is not distinct from p.source
join running r on s.source is not distinct from r.source and s.draw = r.draw
left join extra e on s.source is not distinct from e.source and s.draw = e.draw
"""


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents").select("doc_id", "text"), least=6, often=5, times=5)


# CRC32 by the table of its polynomial; a run's letters are U+0041 to U+007A, one byte each, or U+00C0 to U+00FF, two bytes each
OP11_SQL = r"""
with recursive crc_table as (
  select range as i, list_reduce([range::bigint] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256)),
crc as (select list(v order by i) as t from crc_table),
runs as (
  select coalesce(doc_id::varchar, '') as d, run, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents)
  where length(run) >= 6 group by all),
bytes as (
  select d, run, n, flatten(list_transform(string_split(d || ':' || run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)] else [195, unicode(c) - 64] end)) as b
  from runs),
hashed as (
  select run, n, xor(list_reduce([4294967295::bigint] || b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) as h
  from bytes, crc),
words as (
  select word, sum(n)::bigint as n
  from (select case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed)
  where length(word) >= 6 group by word having sum(n) >= 5),
cut as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select distinct * from (
    select a.word, b.word as other, b.n as other_n from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
    union all select c.word, w.word, w.n from cut c join words w on c.rest = w.word
    union all select w.word, c.word, c.n from cut c join words w on c.rest = w.word)),
best as (select word, count(*)::bigint as n_near, arg_min(other, (-other_n, other)) as other, max(other_n)::bigint as other_n from near group by word),
formed as (
  select words.word, n, coalesce(n_near, 0)::bigint as n_near, case when other_n >= 5 * n then other end as form, case when other_n >= 5 * n then other_n end as form_n
  from words left join best using (word)),
ways as (select word, word as upto, 0 as steps from formed union all select ways.word, form, steps + 1 from ways join formed on upto = formed.word where form is not null),
roots as (select word, arg_max(upto, steps) as root from ways group by word)
select word, form, root, n, n_near, form_n from formed join roots using (word)
"""


def op12_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), innerproducts.quantised(F.col("embedding")).alias("vector"))
    return innerproducts.top_products(vectors, every=50, k=5)


OP12_SQL = """
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.r, q.vec_id as query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::bigint as score
  from v q join v c on q.r <> c.r where q.vec_id % 50 = 0)
select query_id, rank, vec_id, score
from (select *, row_number() over (partition by r order by score desc, vec_id nulls last)::int as rank from scored) where rank <= 5
"""


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _table(spark, sf_dir, "labels"), part="lang")


OP13_SQL = r"""
with marks as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
texts as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part from documents),
read as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, coalesce(doc_id > min(doc_id) over (partition by text), false) as is_copy from texts),
masked as (
  select part, doc_id,
         (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text))::int
         + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * is_copy::int as m
  from read),
cells as (
  select part, m, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from masked left join marks using (doc_id) group by part, m),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l, unnest([1, 2, 4, 8, 16]) as bit),
orders as (
  select a.l || b.l || c.l || d.l || e.l as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from letters a, letters b, letters c, letters d, letters e where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps as (select filter_order, step, bits[step] as bit, list_sum(bits[1:step - 1])::int as before from (select *, unnest(range(1, 6)) as step from orders)),
laid as (
  select part, filter_order, step::int as step, bit,
         sum(case when m & (coalesce(before, 0) | bit) = 0 then n else 0 end)::bigint as kept,
         sum(case when m & coalesce(before, 0) = 0 and m & bit <> 0 then n else 0 end)::bigint as removed,
         sum(case when m & coalesce(before, 0) <> 0 and m & bit <> 0 then n else 0 end)::bigint as redundant,
         sum(case when m = bit then n else 0 end)::bigint as unique_fails,
         sum(case when m & coalesce(before, 0) = 0 and m & bit <> 0 then good else 0 end)::bigint as good_lost,
         sum(case when m & coalesce(before, 0) = 0 and m & bit <> 0 then toxic else 0 end)::bigint as toxic_lost
  from cells, steps group by part, filter_order, step, bit)
select * exclude (bit), sum(removed) over (partition by part, bit)::bigint as shapley from laid
"""


def queries() -> dict:
    return {
        "op1_sharding": op1_sharding,
        "op2_minhash": op2_minhash,
        "op3_lattice": op3_lattice,
        "op4_quality": op4_quality,
        "op5_chat": op5_chat,
        "op6_packing": op6_packing,
        "op7_repeats": op7_repeats,
        "op8_attention": op8_attention,
        "op9_mixing": op9_mixing,
        "op10_fingerprints": op10_fingerprints,
        "op11_spelling": op11_spelling,
        "op12_products": op12_products,
        "op13_audit": op13_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_minhash": OP2_SQL, "op7_repeats": OP7_SQL, "op4_quality": OP4_SQL, "op5_chat": OP5_SQL, "op9_mixing": OP9_SQL,
        "op11_spelling": OP11_SQL, "op12_products": OP12_SQL, "op13_audit": OP13_SQL,
    }
