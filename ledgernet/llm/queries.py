"""The registered queries of the training-data operators, with their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgernet.llm import chat
from ledgernet.llm.collocations import mine_phrases
from ledgernet.llm.columns import crc_remainder
from ledgernet.llm.conversation_repair import digests, repair
from ledgernet.llm.decontamination import find_passages
from ledgernet.llm.embedding_dedup import near_vectors
from ledgernet.llm.kneser_ney import learn_language, score_language
from ledgernet.llm.language_id import identify, learn_languages
from ledgernet.llm.minhash import near_duplicates
from ledgernet.llm.packing import pack
from ledgernet.llm.quality import learn_quality, score_quality
from ledgernet.llm.sharding import interleave
from ledgernet.llm.token_counts import count_prefixes
from ledgernet.llm.toxicity import learn_toxicity, score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def word_tokenizer() -> str:
    """The file of the public tokenizer that packing uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_tokenizer() -> str:
    """The file of the public tokenizer by which tokens are counted."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = find_passages(docs, table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        ((F.col("found.n_hit") > 0) & (20 * F.col("found.n_hit") >= F.col("found.n_words"))).alias("contaminated"),
    )


@query("op1_sharding")
def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    )
    return interleave(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: A conversation whose texts hold the marks of templates.
TRICKY = "\\### Assistant: </turn> ok"

# The template adds 5 characters and an escaped role in front of a text, 8 behind, and one per escaped character.
OP4_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
),
ordered as (
  select *, row_number() over w as i, count(*) over (partition by conv_id) as n,
    13 + length(role) + len(regexp_replace(role, '[^\\#<\n]', '', 'g'))
      + length(text) + len(regexp_replace(text, '[^\\#<]', '', 'g')) as chars
  from rows window w as (partition by conv_id order by turn nulls first, role, text)
),
summed as (
  select *, sum(chars) over (partition by conv_id order by i) as so_far from ordered
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  sum(so_far) filter (role = 'assistant' or i = n)::bigint as formatted_chars
from summed group by conv_id
"""


@query("op4_chat_formatting", OP4_SQL)
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], given.schema)
    examples = chat.expand(given.unionByName(tricky))
    read = examples.select(
        "conv_id",
        "example",
        "formatted",
        chat.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
    )
    told = read.groupBy("conv_id").agg(
        chat.turns_of(F.max_by("formatted", "example")).alias("turns"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


@query("op6_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents").select("doc_id", "text"), word_tokenizer())
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op3_minhash_near_dedup")
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op10_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    model = learn_languages(docs.where(crc_remainder(F.col("doc_id"), 4) != 2))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", out, "lang_pred", F.col("lang_score").alias("score"))


@query("op7_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    seen = crc_remainder(F.col("doc_id"), 5) != 0
    model = learn_toxicity(docs.where(seen), table(spark, sf_dir, "labels"))
    return score_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id", (~seen).alias("held_out"), F.col("toxicity").alias("score"), F.col("is_toxic").cast("int").alias("predicted")
    )


@query("op9_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = crc_remainder(F.col("doc_id"), 3) != 1
    model = learn_quality(docs.where(seen), table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select(
        "doc_id",
        (~seen).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.col("is_good").cast("int").alias("predicted"),
    )


@query("op5_lm_scoring")
def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = crc_remainder(F.col("doc_id"), 10) != 0
    model = learn_language(docs.where(seen))
    return score_language(docs, model).select(
        "doc_id",
        (~seen).alias("held_out"),
        F.col("lm_tokens").alias("n_tokens"),
        F.col("lm_known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.col("lm_base").alias("base_score"),
        F.col("lm_score").alias("score"),
    )


@query("op2_embedding_near_dedup")
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op11_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_prefixes(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_tokenizer(), limit=4096)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "fit_chars")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations, nulls as one space, with a fifth of them lost, emptied, cut, repeated or given to the user."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(told[0], F.lit(":"), told[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    given = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    return given.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit(""))
        .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


# The recursion reads one row of every conversation at a time and keeps the best way to each stack top.
OP13_SQL = r"""
with recursive crc(crcs) as (
  select list_transform(range(256), lambda n: list_reduce(
    list_prepend(n, range(8)), lambda c, i: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1)))
),
given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), '') as told
  from conversations
),
kinds as (
  select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(told, lambda c: ord(c)::bigint)),
    lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 20 as kind
  from given, crc
),
harmed as (
  select conv_id, turn, if(kind = 4, 'user', role) as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from kinds, unnest(range(if(kind = 3, 2, 1)))
  where kind <> 0
),
ordered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as core
  from harmed
),
faults as (
  select *, left(role, 1) as initial,
    case when core = '' then 'blank'
      when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
      when right(core, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    lag(left(role, 1)) over (partition by conv_id order by i) as before
  from ordered
),
shift(top, initial, after) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
expected(top, role, after) as (values (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
inserted(top, letters, said, after) as (
  select top, '', []::varchar[], top from expected
  union all select top, 'I', [role || ':'], after from expected
  union all select a.top, 'II', [a.role || ':', b.role || ':'], b.after from expected a join expected b on a.after = b.top
),
ways as (
  select i.top, i.letters || 'D' as letters, 3 * length(i.letters) + 4 as cost, i.said, null::varchar as initial, null::varchar as role, i.after
  from inserted i
  union all
  select i.top, i.letters || 'K', 3 * length(i.letters), i.said, s.initial, null::varchar, s.after
  from inserted i join shift s on i.after = s.top
  union all
  select i.top, i.letters || 'R', 3 * length(i.letters) + 3, i.said, null::varchar, e.role, e.after
  from inserted i join expected e on i.after = e.top
),
best(conv_id, i, top, cost, audit, said) as (
  select distinct conv_id, 0::bigint, 0, 0::bigint, '', []::varchar[] from harmed
  union all
  select conv_id, i, top, found.cost, found.audit, found.said from (
    select b.conv_id, f.i, w.after as top,
      min({'cost': b.cost + w.cost + if(f.fault = 'truncated' and w.letters not like '%D', 3, 0),
        'audit': b.audit || w.letters,
        'said': b.said || w.said || case when w.letters like '%D' then []::varchar[]
          else [coalesce(w.role, f.role) || ':' || f.text] end}) as found
    from best b join faults f on f.conv_id is not distinct from b.conv_id and f.i = b.i + 1
    join ways w on w.top = b.top and (w.initial is null or w.initial = f.initial)
    where w.letters like '%D' or f.fault not in ('blank', 'duplicate')
    group by b.conv_id, f.i, w.after
  )
),
counts as (
  select conv_id, max(i) as n, count(distinct turn) as turns, min(turn) as least, max(turn) as most,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
  from faults group by conv_id
),
ended as (
  select b.conv_id, min({'cost': b.cost + 3 * length(e.letters), 'audit': b.audit || e.letters, 'said': b.said || e.said}) as found
  from best b join counts c on c.conv_id is not distinct from b.conv_id and c.n = b.i
  join inserted e on e.top = b.top and e.after in (0, 3)
  group by b.conv_id
)
select o.conv_id, coalesce(c.most - c.least + 1 - c.turns, 0)::bigint as gaps,
  coalesce(c.blank, 0)::bigint as blank, coalesce(c.duplicate, 0)::bigint as duplicate,
  coalesce(c.truncated, 0)::bigint as truncated, coalesce(c.illegal, 0)::bigint as illegal,
  coalesce(e.found.cost, 0)::bigint as cost, coalesce(e.found.audit, '') as audit,
  sha256(coalesce(array_to_string(e.found.said, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counts c on c.conv_id is not distinct from o.conv_id
left join ended e on e.conv_id is not distinct from o.conv_id
"""


@query("op13_conversation_repair", OP13_SQL)
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def repaired_conversations(given: DataFrame) -> DataFrame:
    """A row for every conversation, with what its rows, damaged before, were found to lack and became."""
    done = repair(damaged(given))
    told = digests(done.blocks)
    rows = given.select("conv_id").distinct()
    for part in (done.summary, told):
        part = part.withColumnRenamed("conv_id", "_conv")
        rows = rows.join(part, rows["conv_id"].eqNullSafe(part["_conv"]), "left").drop("_conv")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return rows.select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256")
    )


OP12_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, row_number() over () as doc,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) as piece
  from documents
),
split as (
  select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as words from pieces
),
runs as (
  select lang, k, array_to_string(words[i:i + k - 1], ' ') as phrase,
    array_to_string(words[i + 1:i + k - 1], ' ') as without_first, array_to_string(words[i:i + k - 2], ' ') as without_last,
    words[i] as first, words[i + k - 1] as last
  from (select lang, words, unnest(range(1, len(words) + 1)) as i from split) p, (values (1), (2), (3)) t(k)
  where i + k - 1 <= len(words)
),
freq as (
  select lang, k, phrase, count(*) as f, any_value(without_first) as without_first, any_value(without_last) as without_last,
    any_value(first) as first, any_value(last) as last
  from runs group by lang, k, phrase
),
sizes as (select lang, sum(f)::bigint as n from freq where k = 1 group by lang),
frequent as (select * from freq where k > 1 and f >= 10),
cuts as (
  select c.lang, c.phrase, c.k, c.f as a, 1 as cut, l.f as l, r.f as r
  from frequent c join freq l on l.lang = c.lang and l.k = 1 and l.phrase = c.first
  join freq r on r.lang = c.lang and r.k = c.k - 1 and r.phrase = c.without_first
  union all
  select c.lang, c.phrase, c.k, c.f, 2, l.f, r.f
  from frequent c join freq l on l.lang = c.lang and l.k = 2 and l.phrase = c.without_last
  join freq r on r.lang = c.lang and r.k = 1 and r.phrase = c.last
  where c.k = 3
),
scored as (
  select *, (1000000::hugeint * a * a // (l::hugeint * r))::bigint as score from cuts
  qualify row_number() over (partition by lang, phrase, k order by score, cut) = 1
),
inside as (
  select lang, without_first as phrase, f from frequent where k = 3
  union all select lang, without_last, f from frequent where k = 3
),
held as (select lang, phrase, max(f) as most from inside group by lang, phrase),
ranked as (
  select s.lang, row_number() over (partition by s.lang order by s.score desc, s.a desc, s.phrase) as rank, s.phrase, s.a, s.l, s.r, z.n, s.score
  from scored s join sizes z on z.lang = s.lang
  left join held h on s.k = 2 and h.lang = s.lang and h.phrase = s.phrase
  where h.most is null or 100 * h.most < 50 * s.a
)
select * from ranked where rank <= 2000
"""


@query("op12_phrase_mining", OP12_SQL)
def phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_phrases(mine_phrases(table(spark, sf_dir, "documents").select("text", "lang")))


def best_phrases(phrases: DataFrame, most: int = 2000) -> DataFrame:
    """The ``most`` phrases of each language with the highest scores, ranked."""
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = phrases.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
