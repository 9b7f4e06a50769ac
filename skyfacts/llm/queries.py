"""The registered queries of the text operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfacts.llm import attention_lm, decontaminate, kd_search, langid, merkle, nn_descent, packing, quality_fm, simhash, token_blocks, url_rules, warc, whitening

#: Host, path and verdict of the production rules.
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_digests(spark, table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_rules.RULES_SCHEMA)
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, table(spark, sf_dir, "pages"))


def op7_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_texts(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decontaminate.contaminated(documents, table(spark, sf_dir, "benchmark"), F.col("text"))
    return rows.select(
        "row.doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def op9_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"))


def op11_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_search.top_k(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"), tampered=merkle.lower_cased_in_thirds())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_simhash": op2_simhash,
    "op3_token_blocks": op3_token_blocks,
    "op4_packing": op4_packing,
    "op5_url_rules": op5_url_rules,
    "op6_warc": op6_warc,
    "op7_attention_lm": op7_attention_lm,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality_fm": op9_quality_fm,
    "op10_nn_descent": op10_nn_descent,
    "op11_kd_search": op11_kd_search,
    "op12_whitening": op12_whitening,
    "op13_merkle": op13_merkle,
}

#: crc32 of a number's digits: per byte eight steps of the reflected polynomial.
CRC = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''),
    lambda c: [ord(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"""


def _merkle_sql(levels: int = 9, arity: int = 8) -> str:
    """The trees level by level, unrolled: enough for arity ** levels rows of a language."""

    def encoded(column: str) -> str:
        return f"coalesce(octet_length(encode({column}::varchar)) || ':' || {column}::varchar, '-')"

    def digest(text: str) -> str:
        return f"sha256({' || '.join(encoded(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"

    def up(name: str, k: int) -> str:
        """One level from the one before, and each leaf's folded digest and siblings there."""
        return f"""
        {name}{k} as (
            select g, i // {arity} i, sha256(string_agg(d, '' order by i)) d, any_value(n + {arity - 1}) // {arity} n
            from {name}{k - 1} where n > 1 group by g, i // {arity} union all select * from {name}{k - 1} where n = 1
        ), {name}p{k} as (
            select p.doc_id, p.leaf, p.no, p.g, p.i // {arity} i, p.tree,
                p.proof || coalesce(string_agg(s.d, '' order by s.i), '') proof,
                case when any_value(c.n) > 1 then sha256(coalesce(string_agg(s.d, '' order by s.i) filter (s.i < p.i), '') || p.acc
                    || coalesce(string_agg(s.d, '' order by s.i) filter (s.i > p.i), '')) else p.acc end acc
            from {name}p{k - 1} p join (select distinct g, n from {name}{k - 1}) c on c.g = p.g
            left join {name}{k - 1} s on s.g = p.g and s.i // {arity} = p.i // {arity} and s.i <> p.i
            group by p.doc_id, p.leaf, p.no, p.g, p.i, p.tree, p.proof, p.acc
        ),"""

    changed = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
        with leaves as (
            select doc_id, {digest('text')} leaf, case when {CRC} % 3 = 0 then {digest(changed)} else {digest('text')} end now,
                dense_rank() over (order by lang nulls first) - 1 g, row_number() over (order by lang nulls first, doc_id nulls first, {digest('text')}) no
            from documents
        ), numbered as (select *, no - min(no) over (partition by g) i, count(*) over (partition by g) n from leaves),
        a0 as (select g, i, leaf d, n from numbered),
        ap0 as (select doc_id, leaf, no, g, i, g tree, '' proof, now acc from numbered),
        {"".join(up("a", k) for k in range(1, levels + 1))}
        b0 as (select 0 g, g i, d, count(*) over () n from a{levels}),
        bp0 as (select doc_id, leaf, no, 0 g, tree i, tree, proof, acc from ap{levels}),
        {"".join(up("b", k) for k in range(1, levels + 1))}
        told as (
            select doc_id, leaf, s.d subroot, r.d root, sha256(proof) proof_sha256, acc folded_root
            from bp{levels} p join a{levels} s on s.g = p.tree cross join b{levels} r
        )
        select *, folded_root = root verified from told"""


HOST = r"regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')"
PATH = r"regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's')"

SQL: dict[str, str] = {
    "op5_url_rules": f"""
        with parts as (
            select page_id, translate(coalesce({HOST}, ''), '{url_rules.UPPER}', '{url_rules.LOWER}') host, coalesce({PATH}, '') path from pages
        ), rules(h, p, v) as (values {", ".join(map(str, URL_RULES))}),
        fits as (
            select page_id, arg_max(h || p, length(h || p) * 10000 + length(h)) rule, arg_max(v, length(h || p) * 10000 + length(h)) v
            from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id
        )
        select page_id, host, path, rule, coalesce(v, 'allow') verdict from parts left join fits using (page_id)""",
    "op6_warc": f"""
        with rows as (select page_id, coalesce(html, '') html from pages),
        told as (select page_id, octet_length(encode(html)) n, sha256(html) digest from rows),
        firsts as (select digest, min(page_id) first_id from told group by digest)
        select page_id, n::bigint payload_bytes, digest payload_digest,
            case when n >= {warc.LEAST_SHARED} and page_id <> first_id then 'revisit' else 'response' end record_type,
            case when n >= {warc.LEAST_SHARED} and page_id <> first_id then first_id end refers_to
        from told join firsts using (digest)""",
    "op8_decontaminate": """
        with docs as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents
        ), items as (
            select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark
        ), windows as (
            select distinct item_id, least(len(w), 10) n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') win
            from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) i from items where len(w) > 0)
        ), places as (
            select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') win
            from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from docs, (select distinct n from windows) where len(w) >= n)
        ), found as (select doc_id, item_id, i, n from places join windows using (n, win)),
        hit as (select doc_id, count(distinct k) n_hit from (select doc_id, unnest(range(i, i + n)) k from found) group by doc_id),
        named as (
            select doc_id, count(*) n_items, string_agg(name, ',' order by name) names
            from (select distinct doc_id, item_id::varchar name from found) group by doc_id
        )
        select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
            sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
        from docs left join hit using (doc_id) left join named using (doc_id)""",
    "op11_kd_search": """
        with whole as (
            select distinct vec_id, list_transform(embedding, lambda c: floor(1024 * c::double)) x from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
        ), scored as (
            select q.vec_id query_id, c.vec_id, list_dot_product(q.x, c.x)::bigint score
            from whole q join whole c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0
        ), ranked as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int rank from scored)
        select query_id, rank, vec_id, score from ranked where rank <= 10""",
    "op13_merkle": _merkle_sql(),
}
