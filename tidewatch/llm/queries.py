"""The registered query of each operator, and its DuckDB statement where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm import bytepairs, chat, dialogue, imatch, infill, language, mixing, near, packing, quality, substrings, suffixes, warc
from tidewatch.plans.lineage import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(stage(packing.tokenise(table(spark, sf_dir, "documents"), tokenizer())))


@query("op5_mixing")
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(stage(mixing.sizes(table(spark, sf_dir, "documents"))))


@query("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


@query("op9_near_dedup")
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.groups(table(spark, sf_dir, "documents"))


@query("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.sample(docs, ~language.held_out()))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query(
    "op2_chat",
    """
    with turns as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
    ), told as (
        select *, length(role) + length(text) + length(regexp_replace(role || text, '[^<[\\\\]', '', 'g')) + 13 as size from turns
    )
    select conv_id, count(*) as n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
        cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
        sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
        cast(sum(size) as bigint) as formatted_chars
    from told group by conv_id
    """,
)
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    own = spark.sql(f"select * from values (-1L, 0L, 'user', '{text}'), (-1L, 1L, 'assistant', '{text}') as t(conv_id, turn, role, text)")
    return chat.read_back(chat.formatted(turns.unionByName(own)))


@query("op8_fingerprints")
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


@query(
    "op4_warc_revisits",
    r"""
    with folded as (
        select page_id, html, case when page_id % 3 = 0 then regexp_replace(url, '^([A-Za-z]+://[^/?#]*).*$', '\1/') else url end as url from pages
    ), named as (
        select page_id, coalesce(html, '') as html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as u,
            case when lower(trim(url)) like 'https://%' then ':443$' else ':80$' end as port from folded
    ), split as (
        select *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www\.', ''), port, '') as host,
            regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') as path,
            list_filter(list_sort(string_split(regexp_extract(u, '\?(.*)$', 1), '&')),
                lambda x: x <> '' and not regexp_matches(lower(x), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)')) as query
        from named
    ), keyed as (
        select page_id, html, host || path || case when len(query) > 0 then '?' || array_to_string(query, '&') else '' end as key from split
    ), tagged as (
        select page_id, html, key, case when page_id % 17 <> 0 then 'day ' || cast(page_id // 100 as varchar) end as day,
            case when page_id % 7 <> 0 then '"' || substr(md5(html), 1, 12) || '"' end as tag
        from keyed
    ), revisits as (
        select *, case when page_id % 13 = 0 then 8 * page_id - 5 else 8 * page_id + 8001 end as ts,
            case when page_id % 17 = 0 then null when page_id % 11 = 0 then '"other"' else tag end as seen from tagged
    ), found as (
        select r.page_id, r.ts, r.seen, r.day, p.page_id as base, p.tag as base_tag, p.day as base_day, p.html
        from revisits r asof left join (select *, 8 * page_id as at from tagged) p on r.key = p.key and r.ts > p.at
    ), judged as (
        select *, case when base is null then 'no_response' when seen is not null and base_tag is not null then if(seen = base_tag, 'resolved', 'changed')
            when day is null or base_day is null then 'no_validator' when day = base_day then 'resolved' else 'changed' end as status from found
    )
    select cast(2 * page_id + 1 as bigint) as record_id, cast(ts as bigint) as ts, cast(2 * base as bigint) as refers_to, status,
        case when status = 'resolved' then cast(length(html) as varchar) else '0' end as content_length, cast(ts as varchar) as date,
        case when status = 'resolved' then md5(html) end as body_md5
    from judged
    """,
)
def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.captures(table(spark, sf_dir, "pages")))
    header = F.col("headers")
    return found.select("record_id", "ts", "refers_to", "status", header["content-length"].alias("content_length"), header["date"].alias("date"), F.md5("body").alias("body_md5"))


@query("op11_byte_pairs")
def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepairs.digest(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op12_dialogue_repair")
def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.digest(dialogue.damage(table(spark, sf_dir, "conversations")))


@query(
    "op13_fill_in_middle",
    """
    with texts as (
        select row_number() over () as row, doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents
    ), drawn as (
        select *, list_filter(string_split(replace(text, chr(10), chr(10) || chr(0)), chr(0)), lambda x: x <> '') as units,
            cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
            cast('0x' || substr(h, 25, 8) as bigint) as h4
        from texts
    ), cut as (
        select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
            case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form
        from drawn
    ), split as (
        select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix from cut
    )
    select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars,
        case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
        sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
        sha256(text) as restored_sha256
    from split
    """,
)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(table(spark, sf_dir, "documents"))
