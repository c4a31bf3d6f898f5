"""The registered queries of this subpackage: thin wrappers that shape each operator's result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bm25_search import search
from .chat_quotes import link_quotes
from .jaccard_join import jaccard_classes
from .mixing import OWN, mix
from .packing import pack_documents
from .quality_rules import QualityModel, judge
from .store import Workspace
from .substring_dedup import dedup_digest
from .tokens import token_counts
from .url_filter import filter_urls, page_text
from .warc import archive_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, bad): pages whose own text the quality rules reject are bad."""
    model = QualityModel(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), page_text(F.col("html").cast("string")).alias("text"))
    return Workspace(spark, "labels").save(model.labelled(pages, "text"), "urls")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(labelled_urls(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", *[F.col(c).alias(n) for c, n in zip(out.columns[-len(OWN) :], OWN)])


def op5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th document is a query against all documents."""
    docs = _table(spark, sf_dir, "documents")
    return search(docs, docs.where("doc_id % 20 = 0"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digest(_table(spark, sf_dir, "documents"))


def op10_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_warc": op2_warc,
    "op3_url_filter": op3_url_filter,
    "op4_mixing": op4_mixing,
    "op5_search": op5_search,
    "op6_token_counts": op6_token_counts,
    "op7_quality_rules": op7_quality_rules,
    "op8_packing": op8_packing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_chat_quotes": op10_chat_quotes,
}

SQL: dict[str, str] = {
    "op1_jaccard_join": """
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') g from d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) u(i) where len(w) > 0),
n as (select doc_id, count(*) n from s group by doc_id),
l as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.g = b.g and a.doc_id != b.doc_id group by all),
e as (select a, b from l join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select d.doc_id, coalesce(n.n, 0) n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) component_id
from d left join n using (doc_id) left join (select a, min(b) b from r group by a) c on c.a = d.doc_id""",
    "op2_warc": """
with p as (select page_id, strlen(coalesce(html, '')) n, sha256(coalesce(html, '')) g from pages),
f as (select g, min(page_id) first from p where n >= 100 group by g)
select page_id, n payload_bytes, g payload_digest, case when page_id != first then 'revisit' else 'response' end record_type, case when page_id != first then first end refers_to
from p left join f using (g)""",
    "op9_substring_dedup": """
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
p as (select doc_id, i, array_to_string(w[i:i + 34], ' ') g from d, unnest(range(1, greatest(len(w) - 33, 1))) u(i)),
c as (select g from p group by g having count(*) > 1),
h as (select doc_id, i, 1 hit from p semi join c using (g)),
t as (select doc_id, unnest(range(1, len(w) + 1)) i, unnest(w) word from d),
v as (select t.doc_id, t.i, word, max(hit) over (partition by t.doc_id order by t.i rows between 34 preceding and current row) gone from t left join h using (doc_id, i)),
k as (select doc_id, count(gone) n_removed, string_agg(word, ' ' order by i) filter (gone is null) kept from v group by doc_id)
select doc_id, len(w) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join k using (doc_id)""",
}
