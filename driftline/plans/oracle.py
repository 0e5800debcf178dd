"""SQL fragments of the checks: the same questions put to another engine."""

from driftline.fields import (
    CATEGORICAL_FIELDS, CORE_FIELDS, DOI_PREFIX, LOOSE_URL, NUMERIC_FIELDS, STRICT_URL,
)
from driftline.sources.given_tables import EXTENDED_SQL, OCCURRENCE_SQL


def q(name: str) -> str:
    return f'"{name}"'


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def word(key: str, i: int) -> str:
    return f"(('0x' || substr(sha256({key}), {16 * i + 1}, 16))::ubigint % 100)::int"


def dataset_bucket(key: str) -> str:
    return (
        f"({word(key, 0)} * 96 + {word(key, 1)} * 56 + {word(key, 2)} * 16 + {word(key, 3)}) % 100"
    )


def record_bucket(key: str) -> str:
    return word(key, 0)


def split_of(bucket: str) -> str:
    return f"case when {bucket} < 80 then 'train' when {bucket} < 90 then 'dev' else 'test' end"


COMPLETE = " and ".join(f"{q(f)} is not null" for f in CORE_FIELDS)


def with_splits(by: str, complete: bool = True, extended: bool = False) -> str:
    """CTEs ``occ`` and ``sp`` (occurrences with bucket and split)."""
    bucket = dataset_bucket("dataset_id") if by == "dataset" else record_bucket("_id")
    where = f"where {COMPLETE}" if complete else ""
    return (
        f"occ as ({EXTENDED_SQL if extended else OCCURRENCE_SQL}), "
        f"marked as (select *, {bucket} as bucket from occ {where}), "
        f"sp as (select *, {split_of('bucket')} as split from marked)"
    )


def with_sample(by: str, n: int, seed: int = 42, complete: bool = True, extended=False) -> str:
    """CTE ``smp``: the seeded sample of each split."""
    return with_splits(by, complete, extended) + (
        f", ranked as (select *, row_number() over (partition by split "
        f"order by sha256('{seed}:' || _id), _id) as rn from sp), "
        f"smp as (select * from ranked where rn <= {n})"
    )


def unpivot(source: str, fields, name="field", value="value", cast="", keep="split") -> str:
    """One row per field and row of ``source``."""
    return " union all ".join(
        f"select {keep}, {lit(f)} as {name}, {q(f)}{cast} as {value} from {source}" for f in fields
    )


def sizes(cte: str, source: str = "sp") -> str:
    return (
        f"with {cte} select split, count(distinct dataset_id) as datasets, count(*) as n_rows, "
        f"round(count(*) * 100.0 / sum(count(*)) over (), 6) as pct from {source} group by split"
    )


VOCAB = (
    f"occ as ({OCCURRENCE_SQL}), vocab as (select samplingProtocol as v, count(*) as n "
    "from occ group by 1)"
)


def ks_sql(cte: str, source: str, fields=NUMERIC_FIELDS, names=("train", "dev", "test"),
           min_values: int = 20) -> str:
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    pair_rows = ", ".join(f"({lit(a)}, {lit(b)})" for a, b in pairs)
    return f"""with {cte},
long as (select * from ({unpivot(source, fields, 'feature', 'value', '::double')})
         where value is not null),
pairs(split_a, split_b) as (values {pair_rows}),
sides as (select p.split_a, p.split_b, l.feature, l.value,
           count(*) filter (where l.split = p.split_a) as ca,
           count(*) filter (where l.split = p.split_b) as cb
         from long l join pairs p on l.split in (p.split_a, p.split_b) group by all),
steps as (select *, sum(ca) over w as fa, sum(cb) over w as fb,
            sum(ca) over (partition by feature, split_a, split_b) as n_a,
            sum(cb) over (partition by feature, split_a, split_b) as n_b
          from sides window w as (partition by feature, split_a, split_b order by value
                                 rows between unbounded preceding and current row)),
found as (select feature, split_a, split_b, max(n_a) as n_a, max(n_b) as n_b,
            max(abs(fa / nullif(n_a, 0) - fb / nullif(n_b, 0))) as gap
          from steps group by feature, split_a, split_b),
every as (select f.feature, p.split_a, p.split_b, coalesce(t.n_a, 0)::bigint as n_a,
            coalesce(t.n_b, 0)::bigint as n_b, t.gap
          from (values {', '.join(f'({lit(f)})' for f in fields)}) f(feature) cross join pairs p
          left join found t on t.feature = f.feature and t.split_a = p.split_a and t.split_b = p.split_b),
tests as (select *, case when least(n_a, n_b) >= {min_values} then gap end as d from every),
lam as (select *, sqrt(n_a::double * n_b / (n_a + n_b)) as e from tests),
lam2 as (select *, e * d + 1 / (6 * e) + (e * d - 1) / (4 * e * e) as z from lam),
p as (select *, case when d is null then null when z < 0.2 then 1.0::double else greatest(0.0::double, least(1.0::double,
        list_sum(list_transform(range(1, 101),
          lambda k: (case when k % 2 = 1 then 2.0 else -2.0 end)::double
               * exp(-2.0::double * k * k * z * z))))) end as pv from lam2)
select feature, split_a, split_b, n_a, n_b, round(d, 9) as statistic, round(pv, 6) as p_value,
  pv > 0.05 as passed, case when d is null then 'skipped' else 'tested' end as status from p"""


def chi2_tests(cte: str, source: str, fields=CATEGORICAL_FIELDS, names=("train", "dev", "test"),
               min_values: int = 20, top: int = 50) -> str:
    """CTEs up to ``tests``: one chi-squared statistic per feature and pair."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    pair_rows = ", ".join(f"({lit(a)}, {lit(b)})" for a, b in pairs)
    return f"""{cte},
long as (select * from ({unpivot(source, fields, 'feature', 'value', '::varchar')})
         where value is not null),
pairs(split_a, split_b) as (values {pair_rows}),
sides as (select p.split_a, p.split_b, l.feature, l.value,
           count(*) filter (where l.split = p.split_a)::double as oa,
           count(*) filter (where l.split = p.split_b)::double as ob
         from long l join pairs p on l.split in (p.split_a, p.split_b) group by all),
sized as (select *, sum(oa) over t as ta, sum(ob) over t as tb,
            count(*) over t as k_all,
            row_number() over (partition by feature, split_a, split_b order by oa + ob desc, value) as r
          from sides window t as (partition by feature, split_a, split_b)),
capped as (select *, sum(oa) over t as n_a, sum(ob) over t as n_b, count(*) over t as k
           from (select * from sized where r <= {top} and ta >= {min_values} and tb >= {min_values})
           window t as (partition by feature, split_a, split_b)),
expect as (select *, n_a * (oa + ob) / (n_a + n_b) as ea, n_b * (oa + ob) / (n_a + n_b) as eb from capped),
moved as (select *, case when k = 2 then least(0.5, abs(oa - ea)) else 0 end as ma,
                    case when k = 2 then least(0.5, abs(ob - eb)) else 0 end as mb from expect),
found as (select feature, split_a, split_b, k, n_a, n_b, k_all, (n_a + n_b) / (ta + tb) as covered,
            sum((abs(oa - ea) - ma) ** 2 / ea + (abs(ob - eb) - mb) ** 2 / eb) as stat
          from moved where k >= 2 group by all),
tests as (select f.feature, p.split_a, p.split_b, t.* exclude (feature, split_a, split_b), t.stat / 2 as half
          from (values {', '.join(f'({lit(f)})' for f in fields)}) f(feature) cross join pairs p
          left join found t on t.feature = f.feature and t.split_a = p.split_a and t.split_b = p.split_b)"""


# Upper tail of chi-squared in closed form. For odd degrees it starts from the error function, 1 minus a
# series of positive terms, which is below all printed digits from 40 on.
_CHI2_TAIL = """case when half is null then null when half = 0 then 1.0::double else least(1.0::double,
  (case when k % 2 = 1 then exp(-half) when half >= 40 then 0.0::double
    else 1 - list_sum(list_transform(range(0, 300),
      lambda j: exp((j + 0.5::double) * ln(half) - half - lgamma(j + 1.5::double)))) end)
  + coalesce(list_sum(list_transform(range(0, ((k - 2) // 2)::bigint),
      lambda j: exp((j + (case when k % 2 = 1 then 1.0 else 0.5 end)::double) * ln(half) - half
        - lgamma(j + (case when k % 2 = 1 then 2.0 else 1.5 end)::double)))), 0)) end"""


def chi2_sql(cte: str, source: str, p_value: bool = False, **kw) -> str:
    tail = f"round({_CHI2_TAIL}, 6) as p_value, " if p_value else ""
    return f"""with {chi2_tests(cte, source, **kw)}
select feature, split_a, split_b, k as n_categories, n_a::bigint as n_a, n_b::bigint as n_b,
  round(stat, 5) as statistic, (k - 1)::int as dof, round(sqrt(stat / (n_a + n_b)), 7) as cramers_v, {tail}
  k_all as n_all_categories, round(covered, 9) as covered,
  sqrt(stat / (n_a + n_b)) < 0.1 as passed, case when k is null then 'skipped' else 'tested' end as status
from tests"""


# Page to text as SQL of its own: what is dropped with its content, then what breaks a line, other
# tags, character references, and white space.
_DROPPED = [
    "'(?s)<!--.*?(?:-->|\\z)'",
    "'(?is)<script\\b.*?(?:</script\\s*>|\\z)'",
    "'(?is)<style\\b.*?(?:</style\\s*>|\\z)'",
    "'(?is)<head\\b.*?</head\\s*>'",
    "'(?is)<nav\\b.*?</nav\\s*>'",
    "'(?is)<header\\b.*?</header\\s*>'",
    "'(?is)<footer\\b.*?</footer\\s*>'",
    "'(?is)<aside\\b.*?</aside\\s*>'",
    """'(?is)<div class="ad[^"]*">.*?</div\\s*>'""",
]


def html_text(column: str) -> str:
    text = column
    for block in _DROPPED:
        text = f"regexp_replace({text}, {block}, ' ', 'g')"
    breaks = "'(?i)<(?:br|/?(?:p|div|li|h[1-6]|tr|section|article|ul|ol|table)|/title)\\b[^>]*>'"
    text = f"regexp_replace(regexp_replace({text}, {breaks}, chr(10), 'g'), '<[^>]*>', '', 'g')"
    references = [("nbsp", "' '"), ("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("#39", "chr(39)"),
                  ("apos", "chr(39)"), ("amp", "'&'")]
    for name, char in references:
        text = f"replace({text}, '&{name};', {char})"
    lines = f"string_split(regexp_replace({text}, '[ \\t\\r]+', ' ', 'g'), chr(10))"
    kept = f"list_filter(list_transform({lines}, lambda line: trim(line, ' ')), lambda line: line <> '')"
    return f"nullif(array_to_string({kept}, chr(10)), '')"


def matches(column: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({column}, {lit('(?i)' + pattern)}), false)"


def loose(column: str) -> str:
    return matches(column, LOOSE_URL)


def strict(column: str) -> str:
    return matches(column, STRICT_URL)


def real(column: str) -> str:
    return f"({strict(column)} or {matches(column, DOI_PREFIX)})"


def tile(zoom: str) -> tuple[str, str]:
    lat = "least(greatest(decimalLatitude, -85.0511287798066), 85.0511287798066)"
    x = f"floor((decimalLongitude + 180.0) / 360.0 * (2 ** {zoom}))"
    y = (
        f"floor((0.5 - ln((1 + sin(radians({lat}))) / (1 - sin(radians({lat})))) / (4 * pi()))"
        f" * (2 ** {zoom}))"
    )
    return (
        f"least(greatest({x}, 0), 2 ** {zoom} - 1)::int",
        f"least(greatest({y}, 0), 2 ** {zoom} - 1)::int",
    )
