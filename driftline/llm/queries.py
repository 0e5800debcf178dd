"""The operators as queries on the given tables, with SQL checks where SQL can express them."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftline.llm import (
    chat_format, collocations, decontamination, hard_negatives, html_extraction, language_id, line_dedup, ngram_join, packing,
    secret_scan, token_counts, topk_search, toxicity,
)
from driftline.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(check: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if check is not None:
            ORACLE[fn.__name__] = check
        return fn
    return register


@query()
def op1_ngram_join(spark, sf_dir):
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


@query()
def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"))
    model = toxicity.fit(docs.where(~out), table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")


@query()
def op3_token_counts(spark, sf_dir):
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


_LINES = f"""
with pages as (
  select distinct coalesce(source, chr(1)) as host, text from documents where text is not null
), totals as (select host, count(*) as pages from pages group by host),
lines as (
  select distinct host, text, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as line
  from (select host, text, unnest(string_split(text, chr(10))) as line from pages)
), frequent as (
  select host, line from (select host, line, count(*) as n from lines where line <> '' group by host, line)
  join totals using (host) where n >= {line_dedup.MIN_PAGES} and n > pages * {line_dedup.RATIO}
), marked as (
  select d.row, d.doc_id, l.place, l.line, f.line is not null as removed
  from (select row_number() over () as row, * from documents) d,
    unnest(string_split(d.text, chr(10))) with ordinality as l(line, place)
  left join frequent f on f.host = coalesce(d.source, chr(1))
    and f.line = trim(l.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))
)
select any_value(doc_id) as doc_id,
  coalesce(string_agg(line, chr(10) order by place) filter (where not removed), '') as text,
  count(*)::int as n_lines, count(*) filter (where removed)::int as n_removed
from marked group by row
union all select doc_id, null, 0, 0 from documents where text is null
"""


@query(_LINES)
def op4_line_dedup(spark, sf_dir):
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents")).select(
        "doc_id", "text", "n_lines", "n_removed"
    )


@query()
def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~out))
    return language_id.identify(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")


@query()
def op6_html_extraction(spark, sf_dir):
    return html_extraction.extract(table(spark, sf_dir, "pages"))


@query()
def op7_decontamination(spark, sf_dir):
    return decontamination.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TOP = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as terms from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.terms, c.terms), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
) where rank <= 5
"""


@query(_TOP)
def op8_topk_search(spark, sf_dir):
    vectors = topk_search.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


@query()
def op9_packing(spark, sf_dir):
    return packing.pack(cut_documents(table(spark, sf_dir, "documents")))


def cut_documents(docs: DataFrame) -> DataFrame:
    return packing.pieces(
        docs, public_tokenizers.path("byte_bpe_50k.json"),
        rank_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN,
    )


@query()
def op10_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(-1, n, role, "<|im_end|><|im_start|>assistant ok") for n, role in enumerate(("user", "assistant"))],
        "conv_id long, turn long, role string, text string",
    )
    return chat_format.digest_conversations(chat_format.format_turns(turns.unionByName(probe)))


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"

_COLLOCATIONS = f"""
with pieces as (
  select lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) as piece from (
    select coalesce(lang, 'und') as lang, translate(text, '{_UPPER}', '{_LOWER}') as t from documents where text is not null
  )
), words as (
  select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') as w from pieces
), totals as (select lang, sum(len(w))::bigint as n from words group by lang),
grams as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
  from words, (select unnest([1, 2, 3, 4, 5]) as k) where len(w) >= k
), f as (select lang, k, phrase, count(*) as f from grams group by lang, k, phrase having count(*) >= 100),
cuts as (
  select lang, k, phrase, f, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') as head,
    array_to_string(string_split(phrase, ' ')[cut + 1:k], ' ') as rest
  from f, (select unnest([1, 2, 3, 4]) as cut) where cut < k
), scored as (
  select c.lang, c.k, c.phrase, c.f as a, c.cut, h.f as l, r.f as r, t.n,
    ((1000::hugeint * c.f * t.n) // (h.f::hugeint * r.f))::bigint as score
  from cuts c join f h on h.lang = c.lang and h.phrase = c.head join f r on r.lang = c.lang and r.phrase = c.rest
  join totals t on t.lang = c.lang
), lowest as (
  select * from (select *, row_number() over (partition by lang, phrase order by score, cut) as place from scored) where place = 1
), kept as (
  select * from lowest p where not exists (
    select 1 from f q where q.lang = p.lang and q.k > p.k and 100 * q.f >= 100 * p.a
      and contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' ')
  )
)
select * from (
  select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from kept
) where rank <= 2000
"""


@query(_COLLOCATIONS)
def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


_NEGATIVES = """
with v as (
  select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as terms
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as anchor_id, c.vec_id, c.label = q.label as same,
    list_sum(list_transform(list_zip(q.terms, c.terms), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
), positives as (
  select * from (
    select *, row_number() over (partition by anchor_id order by score desc, vec_id) as place from scored where same
  ) where place <= 5
), mined as (
  select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
    row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) as rank
  from positives p join scored n on n.anchor_id = p.anchor_id and not n.same
    and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from mined where rank <= 5
"""


@query(_NEGATIVES)
def op12_hard_negatives(spark, sf_dir):
    given = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding"
    )
    vectors = hard_negatives.labelled_vectors(given)
    return hard_negatives.hard_negatives(vectors, vectors.where(F.col("vec_id") % 100 == 0))


# RE2 folds letters beyond A-Z as well, so both cases are written out.
_KEY = "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")
)
_ASSIGN = rf"""({_KEY})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS, _HEX, _RUN = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}", "[A-Za-z0-9+/_-]{20,}"


def _parts(source: str, pattern: str, group: int = 0) -> str:
    """Matches of a pattern with the gap before each, and the places that follow from both."""
    return f"""
      select *, (coalesce(sum(len(gap) + coalesce(len(match), 0)) over (
        partition by id order by place rows between unbounded preceding and 1 preceding), 0) + len(gap))::int as start
      from (
        select id, unnest(range(1, len(gaps) + 1)) as place, unnest(gaps) as gap, unnest(matches) as match, unnest(found) as value
        from (
          select id, string_split_regex(t, '{pattern}') as gaps, regexp_extract_all(t, '{pattern}', 0) as matches,
            regexp_extract_all(t, '{pattern}', {group}) as found from {source}
        )
      )
    """


_SECRETS = f"""
with docs as (select row_number() over () as id, doc_id, coalesce(text, '') as t from documents),
assign as ({_parts('docs', _ASSIGN, 2)}),
access as ({_parts('docs', _ACCESS)}),
hex as ({_parts('docs', _HEX)}),
base as (
  select id, start, start + len(match) as stop, 0 as ord, 'assign' as kind from assign where len(value) >= 6
  union all select id, start, start + len(match), 1, 'access' from access where match is not null
  union all select id, start, start + len(match), 2, 'hex' from hex where match is not null
), masked as (
  select id, string_agg(gap || case when match is null then '' when len(value) >= 6 then repeat(' ', len(match)) else match end, ''
    order by place) as t from assign group by id
), runs as (
  select id, start, match as token, len(match) as n, least(len(match) // 8, 16) as class,
    case when regexp_matches(match, '^[0-9]+$') then null
      when regexp_matches(match, '^([0-9a-f]+|[0-9A-F]+)$') and regexp_matches(match, '[0-9]') then 'hex'
      when regexp_matches(match, '^[A-Z2-7]+$') and regexp_matches(match, '[2-7]') then 'base32'
      when regexp_matches(match, '^([a-z]+|[A-Z]+)$') then 'one_case'
      when regexp_matches(match, '^[A-Za-z]+$') then 'letters'
      when regexp_matches(match, '^[A-Za-z0-9]+$') then 'alphanumeric' else 'base64' end as encoding
  from ({_parts('masked', _RUN)}) where match is not null and not regexp_matches(match, '{_ACCESS}|{_HEX}')
), plain as (
  select id, regexp_replace(regexp_replace(t, '{_RUN}', ' ', 'g'), '[^A-Za-z0-9]+', '', 'g') as p from masked
), strings as (
  select id, start, n, class, encoding, 'real' as which, token as s from runs where encoding is not null
  union all select id, start, n, class, encoding, 'decoy', substr(p, start % (len(p) - n + 1) + 1, n)
  from runs join plain using (id) where encoding is not null and len(p) >= n
), alphabets as (
  select *, case encoding when 'hex' then '{_DIGITS}abcdef' when 'base32' then '{_UPPER}234567' when 'one_case' then '{_LOWER}'
      when 'letters' then '{_UPPER}{_LOWER}' when 'alphanumeric' then '{_UPPER}{_LOWER}{_DIGITS}'
      else '{_UPPER}{_LOWER}{_DIGITS}+/' end as a,
    case when encoding in ('hex', 'one_case') then lower(s) else translate(s, '-_', '+/') end as folded from strings
), symbols as (
  select *, len(a) as size, n::double as m,
    list_transform(string_split(folded, ''), lambda c: coalesce(nullif(instr(a, c), 0) - 1, ascii(c) % len(a))) as v from alphabets
), means as (
  select *, list_sum(v)::double / m as mean, list_transform(v, lambda w: case when w * 2 >= size then 1 else 0 end) as high from symbols
), sums as (
  select *,
    list_sum(list_transform(range(0, size), lambda k: pow(len(list_filter(v, lambda w: w = k)), 2)))::double as squares,
    list_sum(high)::double as above,
    (list_sum(list_transform(range(1, n), lambda i: abs(high[i] - high[i + 1]))) + 1)::double as runs,
    list_sum(list_transform(range(1, n), lambda i: (v[i] - mean) * (v[i + 1] - mean)))::double as pairs,
    list_sum(list_transform(v, lambda w: (w - mean) * (w - mean)))::double as spread from means
), tests as (
  select *, (squares * size / m - m - (size - 1)) / sqrt((size - 1) * 2 * (m - 1) / m) as z1,
    case when 2 * above * (m - above) > m then (runs - (2 * above * (m - above) / m + 1))
      / sqrt(2 * above * (m - above) * (2 * above * (m - above) - m) / (m * m * (m - 1))) else 8.0 end as z2,
    case when spread > 0 then (pairs / spread + 1.0 / m) * sqrt(m) else 8.0 end as z3 from sums
), tails as (
  select *, list_product(list_transform([z1, z2, z3],
    lambda z: 2.0 / (exp(pow(least(abs(z), 8.0), 3) * 0.07056 + least(abs(z), 8.0) * 1.5976) + 1.0))) as p from tests
), steps as (
  select *, least(floor(least(1.0, p * (ln(p) * ln(p) / 2 - ln(p) + 1)) * 100)::int, 99) as step from tails
), cells as (
  select encoding, class, step, count(*) filter (where which = 'real') as reals, count(*) filter (where which = 'decoy') as decoys
  from steps group by encoding, class, step
), shares as (
  select encoding, class, step, sum(reals) over up as reals_up, sum(decoys) over up as decoys_up,
    sum(reals) over (partition by encoding, class) as reals_all, sum(decoys) over (partition by encoding, class) as decoys_all
  from cells window up as (partition by encoding, class order by step desc)
), limits as (
  select encoding, class, min(step) as least_step from shares
  where decoys_all > 0 and (decoys_up + 1) * reals_all / decoys_all <= reals_up * 0.1 group by encoding, class
), spans as (
  select * from base union all
  select id, start, start + n, 3, 'random' from steps join limits using (encoding, class) where which = 'real' and step >= least_step
), listed as (
  select id, count(*) filter (where ord = 0) as n_assign, count(*) filter (where ord = 1) as n_access,
    count(*) filter (where ord = 2) as n_hex, count(*) filter (where ord = 3) as n_random,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) filter (where ord < 3) as base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) as spans from spans group by id
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  coalesce(n_random, 0) as n_random, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join listed using (id)
"""


@query(_SECRETS)
def op13_secret_scan(spark, sf_dir):
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return found.withColumn("base_sha256", F.sha2(_listed(base), 256)).withColumn("spans", _listed(F.col("spans")))


def _listed(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
