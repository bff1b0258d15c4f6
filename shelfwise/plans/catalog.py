"""The registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.dictionaries import ALIASES, DISPLAY, STOPWORDS
from ..functions.timespec import parse_since
from ..functions.udfs import readme_opening
from ..operators import cluster as C
from ..operators import filters, naming, refine, tokens, vectors, weights
from ..operators.naming import MARKER
from ..sources import snapshots
from . import plan, sync
from .corpora import document_corpus, order_records, part_corpus, remote, space, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NOW = datetime(2001, 8, 1, tzinfo=timezone.utc)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


# --- shared SQL ---------------------------------------------------------------------------

_ORDERS = """
r as (select o_orderkey as id, o_orderpriority || '/order-' || o_custkey as full_name, cast(floor(o_totalprice / 1000) as int) as stars,
  o_orderstatus = 'F' as fork, o_orderstatus = 'P' as archived, o_orderdate as starred_at, o_orderdate as pushed_at from orders)
"""
_PARTS = """
c as (select p_partkey as doc_id, p_brand as owner, p_name as name, p_type as description,
  case when p_type = 'PROMO' then [] else [replace(p_name, ' ', '-'), lower(p_type)] end as topics from part)
"""
_KNOWN = _list(sorted({*ALIASES, *DISPLAY}))


def _clean(x: str) -> str:
    for a, b in ((r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", r" \1 "), (r"<[a-zA-Z/!][^>]*>", " "), (r"\S+://\S+|\bwww\.\S+", " "), (r"(?i)\bc\+\+(\W|$)", r"cpp\1"), (r"(?i)\bc#(\W|$)", r"csharp\1"), (r"(?i)\bf#(\W|$)", r"fsharp\1"), (r"(?i)(^|\W)\.net\b", r"\1dotnet"), (r"(?i)\bnode\.js\b", "nodejs")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


def _toks(name: str, source: str, text: str, keys: str = "doc_id") -> str:
    """CTEs that end in `name`(keys, pos, raw, term): the unstemmed terms of a text column."""
    camel = r"regexp_replace(regexp_replace(w, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g')"
    alias = " ".join(f"when '{k}' then '{v}'" for k, v in ALIASES.items())
    return rf"""
{name}_a as (select {keys}, list_filter(regexp_split_to_array({_clean(text)}, '[^\p{{L}}\p{{Nd}}]+'), lambda w: w <> '') as ws from {source}),
{name}_b as (select {keys}, string_split(array_to_string(list_transform(ws, lambda w: case when lower(w) in ({_KNOWN}) then w else {camel} end), ' '), ' ') as ws from {name}_a),
{name}_c as (select {keys}, generate_subscripts(ws, 1) - 1 as pos, unnest(ws) as raw from {name}_b),
{name}_d as (select *, case lower(raw) {alias} else lower(raw) end as term from {name}_c where strlen(lower(raw)) between 2 and 24),
{name} as (select {keys}, pos, raw, term from {name}_d where term not in ({_list(STOPWORDS)}) and not regexp_full_match(term, 'v?\p{{Nd}}+'))
"""


_DOC_TERMS = _toks("t", "documents", "text") + ", dt as (select doc_id, term, cast(count(*) as double) as weight from t group by 1, 2)"
_VOCAB = """, n as (select count(*) as n from documents),
df as (select term, count(*) as df from dt group by 1),
voc as (select term, df, {idf} as idf from df, n where df between 2 and case when ceil(0.4 * n) < 2 then n else ceil(0.4 * n) end)
"""
_TFIDF_VOCAB = _VOCAB.format(idf="ln((n + 1.0) / (df + 1.0)) + 1.0")
_TFIDF = _TFIDF_VOCAB + """,
w as (select doc_id, term, case when weight < 1 then weight * idf else (1 + ln(weight)) * idf end as w from dt join voc using (term)),
v as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as val from w)
"""
_SPACE = "e as (select vec_id as row_id, label as cluster, cast(embedding as double[]) as vec from embeddings)"
_CENTRES = _SPACE + """,
sm as (select cluster, d, sum(vec[d]) as x, count(*) as size from e cross join range(1, 65) r(d) group by 1, 2),
sv as (select cluster, list(x order by d) as v, max(size) as size from sm group by 1),
cen as (select cluster, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as vec, size from sv),
sims as (select e.row_id, e.cluster, list_inner_product(e.vec, cen.vec) as sim from e join cen using (cluster))
"""


def _floors(sigmas: float) -> str:
    return f"""
md as (select cluster, quantile_cont(sim, 0.5) as med, count(*) as n from sims group by 1),
ma as (select cluster, med, n, quantile_cont(abs(sim - med), 0.5) as mad from sims join md using (cluster) group by 1, 2, 3),
floors as (select cluster, med, mad, n, case when n >= 4 and mad >= 1e-6 then greatest(0.05, least(med - {sigmas} * mad, med - 0.4 * abs(med))) else 0.05 end as floor from ma)
"""


_REMOTE = f"""
d as (select doc_id, lang, source, n_chars, source || '/doc-' || doc_id as full_name from documents),
wanted as (select lang as category, full_name from d),
names as (select upper(lang) as name, count(*) as cnt from d group by 1 union all select source, count(*) from d group by 1),
lists as (select 'L-' || lower(name) as list_id, name, case when name = 'ES' then 'kept by hand' else 'List. {MARKER}' end as description, cnt from names),
mem as (select 'L-' || lang as list_id, full_name from d where n_chars >= 1000 union select 'L-en', full_name from d where n_chars < 300),
cur as (select distinct lower(name) as key, full_name from mem join lists using (list_id)),
want as (select distinct lower(category) as key, full_name from wanted),
ours as (select * from lists where contains(description, '{MARKER}')),
adds as (select * from want except select * from cur),
stale as (select * from cur where key in (select lower(name) from ours) and key in (select key from want) except select * from want)
"""


# --- sources and filters ------------------------------------------------------------------

_CUT = parse_since("5y", NOW)
_GLOBS = ["2-HIGH/*", "order-1??", "*-URGENT/order-[0-9]"]
_REASON = r"""case when fork then 'fork' when archived then 'archived' when stars < 50 then 'min-stars' when starred_at < timestamp '1996-08-01' then 'starred-before'
  when regexp_matches(full_name, '^(?:2-HIGH/[^/]*|[^/]*-URGENT/order-[0-9])$') or regexp_matches(split_part(full_name, '/', 2), '^order-1[^/][^/]$') then 'excluded' end"""


@query(f"with {_ORDERS} select id, {_REASON} as drop_reason from r")
def filter_reasons(spark, sf_dir) -> DataFrame:
    return filters.with_drop_reason(order_records(spark, sf_dir), 50, _CUT, _GLOBS).select("id", "drop_reason")


@query(f"with {_ORDERS}, x as (select {_REASON} as drop_reason from r) select drop_reason, count(*) as n_skipped from x where drop_reason is not null group by 1")
def skip_report(spark, sf_dir) -> DataFrame:
    return filters.skip_report(filters.with_drop_reason(order_records(spark, sf_dir), 50, _CUT, _GLOBS))


@query(rf"with {_ORDERS} select id, full_name from r where regexp_matches(full_name, '^(?:[^/]*-HIGH/[^/]*|5-LOW/order-\d*)$') or regexp_matches(split_part(full_name, '/', 2), '^order-[^/]$')".replace(r"\d*", "[0-9][^/]*"))
def glob_exclude(spark, sf_dir) -> DataFrame:
    r = order_records(spark, sf_dir)
    return r.where(X.matches_glob(F.col("full_name"), ["*-HIGH/*", "5-LOW/order-[0-9]*", "order-?"])).select("id", "full_name")


@query(f"with {_ORDERS} select id, full_name, strftime(pushed_at, '%Y-%m-%d') as pushed from r where pushed_at < timestamp '1999-08-01' order by pushed_at, id limit 10")
def stale_report(spark, sf_dir) -> DataFrame:
    out = filters.stale_report(order_records(spark, sf_dir), F.lit(parse_since("2y", NOW)))
    return out.select("id", "full_name", F.date_format("pushed_at", "yyyy-MM-dd").alias("pushed"))


@query("select event_id, user_id from events where ts >= timestamp '2024-01-31' - interval 604800 seconds")
def ttl_prune(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumnRenamed("ts", "fetched_at")
    return snapshots.unexpired(e, F.lit("2024-01-31").cast("timestamp"), 7 * 86400).select("event_id", "user_id")


@query("select user_id, max(ts) as ts, arg_max(event_type, ts) as event_type from events group by 1")
def harvest_latest(spark, sf_dir) -> DataFrame:
    return snapshots.latest(table(spark, sf_dir, "events"), "user_id", "ts", "event_type")


@query("select d.doc_id, p.html as readme from documents d left join pages p on d.doc_id = p.page_id")
def cache_left_join(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("full_name"))
    cache = table(spark, sf_dir, "pages").select(F.col("page_id").alias("full_name"), F.col("html").alias("text"))
    return snapshots.with_cached_text(docs, cache).select("doc_id", "readme")


@query("""with c as (select doc_id, text from documents), f as (select page_id as doc_id, html as text from pages where html <> '')
select doc_id, text, 1 as fresh from f union all select doc_id, text, 0 from c where doc_id not in (select doc_id from f)""")
def harvest_upsert(spark, sf_dir) -> DataFrame:
    cache = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("full_name"), "text", F.lit(0).alias("fresh"))
    got = table(spark, sf_dir, "pages").select(F.col("page_id").alias("full_name"), F.col("html").alias("text"), F.lit(1).alias("fresh"))
    return snapshots.harvested(cache, got)[0].select(F.col("full_name").alias("doc_id"), "text", "fresh")


@query("select count(*) as n_merged, true as sound from orders")
def topup_overlap(spark, sf_dir) -> DataFrame:
    r = order_records(spark, sf_dir)
    old = r.where("starred_at < timestamp '2000-01-01'")
    page = old.orderBy(F.desc("starred_at"), F.desc("id")).limit(snapshots.PAGE)
    merged, sound = snapshots.topped_up(old, page.unionByName(r.where("starred_at >= timestamp '2000-01-01'")))
    return merged.agg(F.count("*").alias("n_merged")).withColumn("sound", F.lit(sound))


def _texts(spark, sf_dir, *more) -> DataFrame:
    return tokens.spread(table(spark, sf_dir, "documents").select("doc_id", "text", *more))


# --- text and tokens ----------------------------------------------------------------------


@query(r"select doc_id, array_to_string(list_slice(list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda w: w <> ''), 1, 30), ' ') as opening from documents")
def first_words(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.first_words(F.col("text"), 30).alias("opening"))


@query(r"select p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' (' || p_type || ')')), '[^\p{L}\p{Nd}]+', '-', 'g'), '^-+|-+$', '', 'g') as topic from part")
def canonical_topic(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.canonical_topic(F.format_string("%s (%s)", "p_name", "p_type")).alias("topic"))


@query("select 'lang:' || lower(lang) as term, count(*) as n from documents group by 1")
def language_term(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(X.language_term(F.col("lang")).alias("term")).agg(F.count("*").alias("n"))


_SIGNS = " <b>C++</b>, c# or F#; .NET and Node.js [site](http://a.example/x) ![i](y.png) see www.b.example or ftp://c"


@query(f"with x as (select page_id, html || '{_SIGNS}' as text from pages) select page_id, {_clean('text')} as cleaned from x")
def cleaned_pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.clean(F.concat("html", F.lit(_SIGNS))).alias("cleaned"))


@query(f"with x as (select page_id, html || '{_SIGNS}' as text from pages), {_toks('t', 'x', 'text', 'page_id')} select term, count(*) as tf, count(distinct page_id) as df from t group by 1")
def page_terms(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.lit(_SIGNS)).alias("text"))
    return tokens.term_frequencies(pages, key="page_id")


@query(f"with {_toks('t', 'documents', 'text')} select raw, count(*) as n from t_c group by 1")
def camel_tokens(spark, sf_dir) -> DataFrame:
    return tokens.tallied(_texts(spark, sf_dir), "raws")


@query(f"with {_toks('t', 'documents', 'text')} select term, count(*) as tf, count(distinct doc_id) as df from t group by 1")
def normalized_terms(spark, sf_dir) -> DataFrame:
    return tokens.term_frequencies(table(spark, sf_dir, "documents"))


@query()
def stemmed_terms(spark, sf_dir) -> DataFrame:
    vocab = tokens.tallied(_texts(spark, sf_dir), "terms").withColumnRenamed("n", "tf")
    return vocab.withColumn("stem", tokens.stem_of(vocab, "term")).groupBy("stem").agg(F.sum("tf").alias("tf"), F.count("*").alias("n_forms"))


@query(f"""with {_toks('t', 'documents', 'text')}, l as (select term, lag(term) over (partition by doc_id order by pos) as before from t)
select before || ' ' || term as bigram, count(*) as n from l where before <> term group by 1""")
def bigrams(spark, sf_dir) -> DataFrame:
    return tokens.tallied(_texts(spark, sf_dir), "bigrams").select(F.concat_ws(" ", "before", "term").alias("bigram"), "n")


_INDEX = rf"""{_PARTS}, tp as (select regexp_replace(regexp_replace(lower(trim(x)), '[^\p{{L}}\p{{Nd}}]+', '-', 'g'), '^-+|-+$', '', 'g') as canonical from (select unnest(topics) as x from c)),
us as (select canonical, count(*) as uses from tp where canonical <> '' group by 1 having count(*) >= 3), {_toks('it', 'us', 'canonical', 'canonical, uses')},
ip as (select canonical, uses, list(term order by pos) as t from it group by 1, 2 having count(*) = 2),
ix as (select t[1] as w0, t[2] as w1, canonical, uses from ip qualify row_number() over (partition by t[1], t[2] order by uses desc, canonical) = 1)"""


@query(f"with {_INDEX} select * from ix")
def topic_index(spark, sf_dir) -> DataFrame:
    topics = part_corpus(spark, sf_dir).select(F.explode("topics").alias("topic"))
    return tokens.topic_index(topics, 3, stem=False)


@query(f"""with {_INDEX}, bare as (select doc_id, name, description from c where len(topics) = 0), {_toks('nt', 'bare', 'name')}, {_toks('xt', 'bare', 'description')},
pr as (select doc_id, lag(term) over (partition by doc_id order by pos) as w0, term as w1, 1.5 as w from nt union all select doc_id, lag(term) over (partition by doc_id order by pos), term, 1.0 from xt)
select doc_id, 'topic:' || canonical as term, cast(sum(w) as double) as weight from pr join ix using (w0, w1) group by 1, 2""")
def topic_inference(spark, sf_dir) -> DataFrame:
    c = part_corpus(spark, sf_dir)
    index = tokens.topic_index(c.select(F.explode("topics").alias("topic")), 3, stem=False)
    return tokens.inferred_topics(c, index, stem=False).groupBy("doc_id", "term").agg(F.sum("weight").cast("double").alias("weight"))


_FIELDS = rf"""{_PARTS}, el as (select doc_id, generate_subscripts(topics, 1) as e, unnest(topics) as topic from c), {_toks('tt', 'el', 'topic', 'doc_id, e, topic')},
tw as (select *, count(*) over (partition by doc_id, e) > 1 as whole from tt), {_toks('ot', 'c', 'owner')}, {_toks('nt', 'c', 'name')}, {_toks('xt', 'c', 'description')},
jn as (select doc_id, lower(regexp_replace(trim(name), '[^\p{{L}}\p{{Nd}}]+', '', 'g')) as term from c where regexp_matches(trim(name), '[^\p{{L}}\p{{Nd}}]')),
f as (select doc_id, term, case when whole then 1.2 else 3.0 end as w, 1 as top from tw
  union all select distinct doc_id, 'topic:' || topic, 3.0, 1 from tw where whole
  union all select doc_id, term, 0.5, 0 from ot union all select doc_id, term, 2.0, 0 from nt union all select doc_id, term, 1.0, 0 from xt
  union all select j.doc_id, j.term, 2.0, 0 from jn j where not exists (select 1 from nt where nt.doc_id = j.doc_id and nt.term = j.term)),
ft as (select doc_id, term, cast(sum(w) as double) as weight, cast(coalesce(sum(w) filter (where top = 1), 0) as double) as topic_weight from f group by 1, 2)"""


@query(f"with {_FIELDS} select * from ft")
def field_weights(spark, sf_dir) -> DataFrame:
    return tokens.weighted_terms(part_corpus(spark, sf_dir), stem=False)[0]


# --- vectors ------------------------------------------------------------------------------


def _chunks(spark, sf_dir, *more) -> tuple[DataFrame, int]:
    docs = table(spark, sf_dir, "documents")
    return weights.chunked(docs, "doc_id", "text", *more), docs.count()


def _frequencies(spark, sf_dir) -> tuple[DataFrame, int]:
    docs = table(spark, sf_dir, "documents")
    return tokens.term_frequencies(docs).withColumnRenamed("tf", "total"), docs.count()


@query(f"with {_DOC_TERMS}{_TFIDF_VOCAB} select term, df, round(idf, 6) as idf from voc")
def vocab_prune(spark, sf_dir) -> DataFrame:
    t, n = _frequencies(spark, sf_dir)
    return vectors.vocabulary(t, n).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"with {_DOC_TERMS}{_TFIDF_VOCAB} select term, df from voc order by round(df * idf, 9) desc, term limit 1000")
def vocab_cap(spark, sf_dir) -> DataFrame:
    t, n = _frequencies(spark, sf_dir)
    return vectors.vocabulary(t, n, cap=1000).select("term", "df")


@query(f"with {_DOC_TERMS}{_TFIDF} select doc_id, term, round(val, 6) as val from v")
def tfidf(spark, sf_dir) -> DataFrame:
    c, n = _chunks(spark, sf_dir)
    return weights.vectors_of(c, weights.chunk_vocabulary(c, n)).select("doc_id", "term", F.round("val", 6).alias("val"))


@query(f"""with {_DOC_TERMS}{_VOCAB.format(idf="ln(1.0 + (n - df + 0.5) / (df + 0.5))")},
ins as (select doc_id, term, idf, weight from dt join voc using (term)), ln as (select doc_id, sum(weight) as len from ins group by 1),
av as (select case when sum(len) > 0 then sum(len) / max(n) else 1.0 end as mean from ln, n),
w as (select doc_id, term, idf * weight * 2.2 / (weight + 1.2 * (0.25 + 0.75 * len / mean)) as w from ins join ln using (doc_id), av)
select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as val from w""")
def bm25(spark, sf_dir) -> DataFrame:
    c, n = _chunks(spark, sf_dir)
    vocab = weights.with_mean_length(weights.chunk_vocabulary(c, n, bm25=True), n)
    return weights.vectors_of(c, vocab).select("doc_id", "term", F.round("val", 6).alias("val"))


@query(f"""with {_DOC_TERMS}{_TFIDF}, l as (select v.*, lang from v join documents using (doc_id)), m as (select lang, term, avg(val) as val from l group by 1, 2)
select l.doc_id, m.lang, round(sum(l.val * m.val), 6) as sim from l join m using (term) group by 1, 2""")
def sparse_cosine(spark, sf_dir) -> DataFrame:
    c, n = _chunks(spark, sf_dir, "lang")
    return weights.class_cosines(c, weights.chunk_vocabulary(c, n), "lang").withColumn("sim", F.round("sim", 6))


@query()
def lsa(spark, sf_dir) -> DataFrame:
    t, n = _frequencies(spark, sf_dir)
    vocab = vectors.vocabulary(t, n, cap=12_000).cache()
    return vectors.latent_space_of(weights.rows_of(table(spark, sf_dir, "documents"), vocab), vocab.count())


# --- clusters -----------------------------------------------------------------------------


@query(f"with {_SPACE} select a.row_id as i, b.row_id as j, round(cast(greatest(0, 2 * (1 - list_inner_product(a.vec, b.vec))) as float)::double, 5) as distance from e a join e b on a.row_id < b.row_id")
def pairwise_distance(spark, sf_dir) -> DataFrame:
    return C.pair_distances(space(spark, sf_dir)).withColumn("distance", F.round(F.col("distance").cast("double"), 5))


@query(f"with {_CENTRES} select cluster, d as dim, round(vec[d], 6) as x from cen cross join range(1, 65) r(d)")
def centroids(spark, sf_dir) -> DataFrame:
    c = C.centroids(space(spark, sf_dir))
    return c.select("cluster", F.posexplode("vec").alias("at", "x")).select("cluster", (F.col("at") + 1).cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query(f"with {_CENTRES} select cluster, round(avg(sim), 6) as cohesion, count(*) as size from sims group by 1")
def cohesion(spark, sf_dir) -> DataFrame:
    s = space(spark, sf_dir)
    return C.cohesions(C.similarities(s, C.centroids(s))).withColumn("cohesion", F.round("cohesion", 6))


@query(f"""with {_SPACE}, m as (select a.row_id as i, a.cluster as ci, b.cluster as cj, avg(1 - list_inner_product(a.vec, b.vec)) as d from e a join e b on a.row_id <> b.row_id group by 1, 2, 3),
p as (select i, min(d) filter (where ci = cj) as own, min(d) filter (where ci <> cj) as other from m group by 1)
select round(avg((other - own) / greatest(own, other)), 6) as score, count(*) as n from p where own is not null and other is not null and greatest(own, other) > 0""")
def silhouette(spark, sf_dir) -> DataFrame:
    return C.silhouette(space(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"with {_CENTRES}, {_floors(3.0)} select cluster, round(floor, 6) as floor, round(med, 6) as med, round(mad, 6) as mad, n from floors")
def fit_floors(spark, sf_dir) -> DataFrame:
    s = space(spark, sf_dir)
    f = refine.fit_floors(C.similarities(s, C.centroids(s)))
    return f.select("cluster", *[F.round(c, 6).alias(c) for c in ("floor", "med", "mad")], "n")


@query(f"with {_CENTRES}, {_floors(1.0)} select row_id, cluster, round(sim, 6) as sim from sims join floors using (cluster) where sim < floor")
def outliers(spark, sf_dir) -> DataFrame:
    s = space(spark, sf_dir)
    sims = C.similarities(s, C.centroids(s))
    return refine.outliers(sims, refine.fit_floors(sims, sigmas=1.0)).select("row_id", "cluster", F.round("sim", 6).alias("sim"))


@query(f"""with {_CENTRES}, {_floors(1.0)}, gone as (select row_id from sims join floors using (cluster) where sim < floor),
nb as (select a.row_id, b.row_id as other, b.cluster from e a join e b on a.row_id in (select row_id from gone) and b.row_id not in (select row_id from gone)
  qualify row_number() over (partition by a.row_id order by round(list_inner_product(a.vec, b.vec), 9) desc, b.row_id) <= 10),
vt as (select row_id, cluster, count(*) as votes from nb group by 1, 2), f as (select *, cast(sum(votes) over (partition by row_id) as bigint) as found from vt)
select row_id, cluster, votes, found from f qualify row_number() over (partition by row_id order by votes desc, cluster) = 1 and votes >= 0.3 * found - 1e-9""")
def knn_rescue(spark, sf_dir) -> DataFrame:
    s = space(spark, sf_dir)
    sims = C.similarities(s, C.centroids(s))
    gone = refine.outliers(sims, refine.fit_floors(sims, sigmas=1.0)).select("row_id")
    near = refine.neighbours(s.join(gone, "row_id", "left_semi"), s.join(gone, "row_id", "left_anti"), 10, most=s.count())
    return refine.rescued(near, 0.3).select("row_id", "cluster", "votes", "found")


_SURVIVE = "sz as (select cluster, count(*) as size, avg(sim) as cohesion from sims group by 1), sv2 as (select * from sz where size >= 4 and round(cohesion, 9) >= 0.1 order by size desc, cluster limit 6)"


@query(f"with {_CENTRES}, {_SURVIVE} select cluster, size, round(cohesion, 6) as cohesion from sv2")
def survivors(spark, sf_dir) -> DataFrame:
    s = space(spark, sf_dir)
    kept = refine.survivors(C.cohesions(C.similarities(s, C.centroids(s))), 4, 0.1, 6)
    return kept.select("cluster", "size", F.round("cohesion", 6).alias("cohesion"))


@query(f"""with {_CENTRES}, {_SURVIVE}, fr as (select * from e where cluster not in (select cluster from sv2)),
pp as (select f.row_id, c.cluster, list_inner_product(f.vec, c.vec) as sim, s.cohesion from fr f cross join cen c join sv2 s on s.cluster = c.cluster)
select row_id, cluster, round(sim, 6) as sim from pp where sim > 0.05 and sim >= greatest(0.05, 0.6 * cohesion) qualify row_number() over (partition by row_id order by round(sim, 9) desc, cluster) = 1""")
def rehome(spark, sf_dir) -> DataFrame:
    s = space(spark, sf_dir)
    centres = C.centroids(s)
    kept = refine.survivors(C.cohesions(C.similarities(s, centres)), 4, 0.1, 6)
    free = s.join(kept.select("cluster"), "cluster", "left_anti")
    return refine.rehomed(free, centres, kept).select("row_id", "cluster", F.round("sim", 6).alias("sim"))


@query(f"with {_SPACE}, s as (select cluster, count(*) as size from e group by 1) select cluster, size, row_number() over (order by size desc, cluster) - 1 as number from s")
def renumber(spark, sf_dir) -> DataFrame:
    sizes = space(spark, sf_dir).groupBy("cluster").agg(F.count("*").alias("size"))
    return refine.renumbered(sizes).withColumn("number", F.col("number").cast("long"))


@query(f"""with {_CENTRES}, ow as (select row_id, cluster as own, 0.8 * sim as floor from sims),
pr as (select e.row_id, c.cluster, list_inner_product(e.vec, c.vec) as sim, floor from e join ow using (row_id) join cen c on c.cluster <> ow.own)
select row_id, cluster, round(sim, 6) as sim, row_number() over (partition by row_id order by round(sim, 9) desc, cluster) as rank from pr where floor > 0 and sim >= floor qualify rank <= 2""")
def soften(spark, sf_dir) -> DataFrame:
    s = space(spark, sf_dir)
    return refine.softened(s, C.centroids(s), 0.8, 3).select("row_id", "cluster", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query(f"""with {_CENTRES.replace('from embeddings)', 'from embeddings where label <> 9)')}, {_floors(3.0)}, nw as (select vec_id as row_id, cast(embedding as double[]) as vec from embeddings where label = 9),
b as (select n.row_id, c.cluster, list_inner_product(n.vec, c.vec) as sim from nw n cross join cen c qualify row_number() over (partition by n.row_id order by round(list_inner_product(n.vec, c.vec), 9) desc, c.cluster) = 1)
select row_id, cluster, round(sim, 6) as sim from b join floors using (cluster) where sim >= floor""")
def place_incremental(spark, sf_dir) -> DataFrame:
    s = space(spark, sf_dir)
    old, new = s.where("cluster <> 9"), s.where("cluster = 9")
    centres = C.centroids(old)
    out = refine.placed(new, centres, refine.fit_floors(C.similarities(old, centres)))
    return out.select("row_id", "cluster", F.round("sim", 6).alias("sim"))


@query()
def ward(spark, sf_dir) -> DataFrame:
    return C.ward(space(spark, sf_dir).select("row_id", "vec"), 10)


@query()
def kmeans(spark, sf_dir) -> DataFrame:
    return C.kmeans(space(spark, sf_dir).select("row_id", "vec").persist(), 10)[0]


@query()
def consensus(spark, sf_dir) -> DataFrame:
    return C.consensus(space(spark, sf_dir).select("row_id", "vec").persist(), 10, runs=2)[0]


@query()
def refine_clusters(spark, sf_dir) -> DataFrame:
    return refine.refined(space(spark, sf_dir), min_cohesion=0.1)


# --- names --------------------------------------------------------------------------------

_CLASS = f"""{_DOC_TERMS}, bl as (select doc_id, term, lag(term) over (partition by doc_id order by pos) as b from t),
u as (select doc_id, term, weight as w from dt union all select doc_id, b || ' ' || term, 1.35 from bl where b <> term),
p as (select lang as cluster, term, sum(cast(w as decimal(24, 8))) as w from u join documents using (doc_id) group by 1, 2),
q as (select cluster, term, cast(w as double) as w, cast(sum(w) over (partition by cluster) as double) as tot, cast(sum(w) over (partition by term) as double) as gl from p),
sc as (select cluster, term, w / tot * (w / gl) as score, w from q)
"""


def _scores(spark, sf_dir) -> DataFrame:
    counted = tokens.tallies(_texts(spark, sf_dir, F.col("lang").alias("cluster")), "both", by="cluster")
    units = F.when(F.col("before").isNull(), tokens.MILLION).otherwise(round(naming.BIGRAM_BOOST * tokens.MILLION))
    each = counted.select("cluster", F.concat_ws(" ", "before", "term").alias("term"), (F.col("n") * units).alias("w"))
    per = each.repartition("term").groupBy("cluster", "term").agg(F.sum("w").alias("w"))
    return naming.shares(per.withColumn("t", F.lit(0).cast("long")))


@query(f"with {_CLASS} select cluster, term, round(score, 9) as score, row_number() over (partition by cluster order by round(score, 12) desc, term) as rank from sc qualify rank <= 6")
def ctfidf_terms(spark, sf_dir) -> DataFrame:
    return naming.top_terms(_scores(spark, sf_dir), 6).select("cluster", "term", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"with {_toks('t', 'documents', 'text')}, m as (select term, raw as surface, count(*) as n from t group by 1, 2) select * from m qualify row_number() over (partition by term order by n desc, surface) = 1")
def display_forms(spark, sf_dir) -> DataFrame:
    t = tokens.tallied(_texts(spark, sf_dir), "pairs")
    return naming.modal(t.withColumnRenamed("raw", "surface"), "term", "surface")


@query(rf"""with {_toks('t', 'documents', 'text')}, m as (select lower(raw) as word, raw as written, count(*) as n from t group by 1, 2), b as (select *, sum(n) over (partition by word) as total from m qualify row_number() over (partition by word order by n desc, written) = 1)
select word, written, n from b where n >= 3 and 2 * n > total and regexp_matches(substr(written, 2), '\p{{Lu}}')""")
def distinctive_casing(spark, sf_dir) -> DataFrame:
    t = tokens.tallied(_texts(spark, sf_dir), "pairs")
    return naming.distinctive_casing(t.select(F.lower("raw").alias("word"), F.col("raw").alias("written"), "n"))


@query(f"""with {_CLASS}, ld as (select cluster, term as lead from sc where term not like '% %' qualify row_number() over (partition by cluster order by round(score, 12) desc, term) = 1)
select lang as cluster, round(count(x.term) / count(*), 6) as coverage, count(*) as size from documents join ld on lang = cluster left join (select distinct doc_id, term from t) x on x.doc_id = documents.doc_id and x.term = lead group by 1""")
def name_coverage(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leads = naming.top_terms(_scores(spark, sf_dir).where("not contains(term, ' ')"), 1).select("cluster", F.col("term").alias("lead"))
    leads = spark.createDataFrame(leads.collect(), leads.schema)  # a row a cluster
    t = tokens.term_counts(docs).join(leads.select(F.col("lead").alias("term")).distinct(), "term", "left_semi")
    out = naming.name_coverage(docs.select("doc_id", F.col("lang").alias("cluster")), t, leads)
    return out.withColumn("coverage", F.round("coverage", 6))


@query(f"""with {_CLASS}, tp as (select cluster, list(distinct term) as t from (select * from sc qualify row_number() over (partition by cluster order by round(score, 12) desc, term) <= 200) group by 1)
select a.cluster as a, b.cluster as b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) as overlap from tp a join tp b on a.cluster < b.cluster""")
def label_jaccard(spark, sf_dir) -> DataFrame:
    labels = naming.top_terms(_scores(spark, sf_dir), 200).groupBy("cluster").agg(F.collect_list("term").alias("terms"))
    return naming.label_overlaps(labels).withColumn("overlap", F.round("overlap", 6))


@query()
def names(spark, sf_dir) -> DataFrame:
    docs = _texts(spark, sf_dir)
    surfaces = tokens.tallied(docs, "terms").select("term", F.col("term").alias("surface"))  # not stemmed: a term is its surface
    pairs = tokens.tallied(docs, "pairs")
    cased = naming.distinctive_casing(pairs.select(F.lower("raw").alias("word"), F.col("raw").alias("written"), "n"))
    return spark.createDataFrame(naming.labels(_scores(spark, sf_dir), surfaces, cased), "cluster string, name string, terms array<string>, scores array<double>, lead string, description string")


# --- plans and synchronisation ------------------------------------------------------------


def _members(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = space(spark, sf_dir)
    m = C.similarities(s, C.centroids(s)).select("cluster", F.format_string("v/%d", "row_id").alias("full_name"), F.col("sim").alias("similarity"))
    labels = s.select("cluster", F.format_string("Group %d", "cluster").alias("name")).distinct()
    lists = table(spark, sf_dir, "nation").select(F.format_string("GROUP %d", "n_nationkey").alias("name")).where("name < 'GROUP 5'")
    return m, labels, lists


@query(f"""with {_CENTRES} select cluster, 'Group ' || cluster as name, count(*) as size, floor(avg(sim) * 1000 + 0.5) / 1000 as cohesion,
'GROUP ' || cluster < 'GROUP 5' as "exists", arg_min('v/' || row_id, (-round(sim, 9), 'v/' || row_id)) as first_member from sims group by 1""")
def plan_build(spark, sf_dir) -> DataFrame:
    out = plan.categories(*_members(spark, sf_dir))
    return out.select("cluster", "name", "size", "cohesion", "exists", F.col("repos")[0]["full_name"].alias("first_member"))


@query("select count(distinct source) as n_categories, count(*) as n_placements, count(distinct lang) as n_repos from documents")
def plan_counts(spark, sf_dir) -> DataFrame:
    return plan.counts(table(spark, sf_dir, "documents").select(F.col("source").alias("category"), F.col("lang").alias("full_name")))


@query(f"""with pc as (select n_nationkey as position, case when n_regionkey = 0 then '' when n_regionkey = 1 then repeat(n_name, 5) else 'Region ' || n_regionkey end as name,
 case when n_regionkey = 2 then repeat('long ', 40) || '{MARKER}' when n_regionkey = 3 then 'by hand' else '{MARKER}' end as description from nation),
lab as (select *, case when lower(trim(name)) = '' then '#' || position else name end as category, lower(trim(name)) as key from pc),
pl as (select s_nationkey as position, case when s_acctbal < 0 then s_name else 'a/b' end as full_name from supplier),
m as (select lab.category, lab.position, full_name, regexp_matches(full_name, '^[^/]+/.+$') as ok from pl join lab using (position))
select 'empty-name' as rule, category, '' as detail from lab where key = ''
union all select 'long-name', category, cast(length(name) as varchar) from lab where key <> '' and length(name) > 32
union all select 'same-name', category, key from lab where key <> '' and position > (select min(position) from lab x where x.key = lab.key)
union all select 'long-description', category, cast(length(description) as varchar) from lab where length(description) > 160
union all select 'no-marker', category, '' from lab where not contains(description, '{MARKER}')
union all select 'bad-repo', category, full_name || ': not owner/name' from m where not ok
union all select 'repeated-repo', category, lower(full_name) from m where ok group by category, position, lower(full_name) having count(*) > 1
union all select 'bad-unassigned', 'unassigned', c_name || ': not owner/name' from customer where c_acctbal < -900""")
def plan_violations(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    name = F.when(F.col("n_regionkey") == 0, "").when(F.col("n_regionkey") == 1, F.expr("repeat(n_name, 5)")).otherwise(F.concat(F.lit("Region "), F.col("n_regionkey").cast("string")))
    text = F.when(F.col("n_regionkey") == 2, F.lit("long " * 40 + MARKER)).when(F.col("n_regionkey") == 3, "by hand").otherwise(F.lit(MARKER))
    cats = n.select(F.col("n_nationkey").alias("position"), name.alias("name"), text.alias("description"))
    placed = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("position"), F.when(F.col("s_acctbal") < 0, F.col("s_name")).otherwise("a/b").alias("full_name"))
    loose = table(spark, sf_dir, "customer").where("c_acctbal < -900").select(F.col("c_name").alias("full_name"))
    return plan.violations(cats, placed, loose)


@query(f"with {_REMOTE} select * from adds")
def sync_additions(spark, sf_dir) -> DataFrame:
    return sync.additions(*remote(spark, sf_dir))


@query(f"with {_REMOTE} select * from want intersect select * from cur")
def sync_skipped(spark, sf_dir) -> DataFrame:
    return sync.skipped(*remote(spark, sf_dir))


@query(f"with {_REMOTE} select * from stale")
def sync_stale(spark, sf_dir) -> DataFrame:
    return sync.stale(*remote(spark, sf_dir))


@query(f"""with {_REMOTE}, ch as (select full_name from adds union select full_name from stale), al as (select * from cur except select * from stale union select * from adds)
select full_name, coalesce(string_agg(key, ',' order by key), '') as keys from ch left join al using (full_name) group by 1""")
def desired_sets(spark, sf_dir) -> DataFrame:
    return sync.desired_sets(*remote(spark, sf_dir)).withColumn("keys", F.array_join("keys", ","))


@query(f"with {_REMOTE} select list_id, name from ours where lower(name) not in (select key from want)")
def reconcile_drop(spark, sf_dir) -> DataFrame:
    wanted, lists, _ = remote(spark, sf_dir)
    return sync.dropped_lists(wanted, lists).select("list_id", "name")


@query(f"""with {_REMOTE}, s as (select (select count(*) from lists) as n_existing, (select count(distinct key) from want where key not in (select lower(name) from lists)) as n_new)
select n_existing, n_new, n_existing + n_new <= 20 as fits from s""")
def list_budget(spark, sf_dir) -> DataFrame:
    wanted, lists, _ = remote(spark, sf_dir)
    return sync.list_budget(wanted, lists, 20)


@query(f"with {_REMOTE} select list_id, cnt as count from ours where lower(name) not in (select key from want) qualify row_number() over (order by cnt, list_id) <= (select count(*) from lists) - 20")
def list_freed(spark, sf_dir) -> DataFrame:
    wanted, lists, _ = remote(spark, sf_dir)
    return sync.freed_lists(wanted, lists, 20).select("list_id", "count")


@query(f"with {_REMOTE} select key, full_name, key not in (select lower(name) from lists) as list_missing from adds")
def verify_missing(spark, sf_dir) -> DataFrame:
    return sync.missing(*remote(spark, sf_dir))


@query(f"with {_REMOTE} select list_id, name from ours")
def reset_managed(spark, sf_dir) -> DataFrame:
    return sync.resettable(remote(spark, sf_dir)[1]).select("list_id", "name")


@query(f"with {_REMOTE} select list_id, name from lists where not contains(description, '{MARKER}') and lower(name) in (select key from want)")
def list_conflicts(spark, sf_dir) -> DataFrame:
    wanted, lists, _ = remote(spark, sf_dir)
    return sync.conflicts(wanted, lists).select("list_id", "name")


@query(f"""with {_REMOTE}, ok as (select * from want where key in (select lower(name) from ours) or key not in (select lower(name) from lists)),
log as (select 'add' as action, * from (select * from ok except select * from cur) union all select 'remove', * from stale where key in (select key from ok)) select * from log""")
def apply_log(spark, sf_dir) -> DataFrame:
    return sync.apply(*remote(spark, sf_dir), sync.Options(reconcile=True))[1]


_OK = "ok as (select * from want where key in (select lower(name) from ours) or key not in (select lower(name) from lists))"


@query(f"with {_REMOTE}, {_OK} select 'add' as action, * from (select * from ok except select * from cur)")
def apply_additions(spark, sf_dir) -> DataFrame:
    return sync.apply(*remote(spark, sf_dir))[1]


@query(f"with {_REMOTE}, {_OK}, a as (select * from ok except select * from cur) select 'add' as action, key, full_name from a qualify dense_rank() over (order by full_name) <= 40")
def apply_capped(spark, sf_dir) -> DataFrame:
    return sync.apply(*remote(spark, sf_dir), sync.Options(limit=40))[1]


@query(f"with {_REMOTE} select 'add' as action, key, full_name from adds")
def apply_adopting(spark, sf_dir) -> DataFrame:
    return sync.apply(*remote(spark, sf_dir), sync.Options(adopt=True))[1]


@query(f"with {_REMOTE}, a as (select * from adds where key = 'en') select 'add' as action, key, full_name from a union all select 'remove', key, full_name from stale where key = 'en'")
def apply_selected(spark, sf_dir) -> DataFrame:
    return sync.apply(*remote(spark, sf_dir), sync.Options(only=(" EN,",), reconcile=True))[1]


@query(f"with {_REMOTE}, {_OK} select key, full_name, false as list_missing from (select * from ok except select * from cur)")
def verify_applied(spark, sf_dir) -> DataFrame:
    state = remote(spark, sf_dir)
    return sync.verified(*state, sync.applied(*state))


@query(f"with {_REMOTE}, {_OK}, a as (select * from ok except select * from cur) select key, full_name, false as list_missing from a qualify dense_rank() over (order by full_name) <= 40")
def verify_capped(spark, sf_dir) -> DataFrame:
    state = remote(spark, sf_dir)
    return sync.verified(*state, sync.applied(*state, sync.Options(limit=40)))


@query("""with a as (select distinct 'o/' || o_custkey as full_name from orders), k as (select 'o/' || c_custkey as full_name, 'R-' || c_custkey as repo_id from customer where c_acctbal >= 0)
select full_name, repo_id from a left join k using (full_name)""")
def resolved_ids(spark, sf_dir) -> DataFrame:
    return sync.resolved(*_asked(spark, sf_dir))


@query("""with a as (select distinct 'o/' || o_custkey as full_name from orders) select full_name from a where full_name not in (select 'o/' || c_custkey from customer where c_acctbal >= 0)""")
def unresolved_names(spark, sf_dir) -> DataFrame:
    return sync.unresolved(*_asked(spark, sf_dir))


def _asked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Names asked for, and the answers: those who owe money are unknown."""
    names = table(spark, sf_dir, "orders").select(F.concat(F.lit("o/"), F.col("o_custkey").cast("string")).alias("full_name"))
    who = F.col("c_custkey").cast("string")
    known = table(spark, sf_dir, "customer").select(F.concat(F.lit("o/"), who).alias("full_name"), F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("R-"), who)).otherwise("").alias("repo_id"))
    return names, known


@query(f"""with {_REMOTE}, {_OK}, a as (select * from ok except select * from cur), k as (select full_name from d where n_chars >= 500)
select full_name, case when full_name not in (select full_name from k) then 'unknown: renamed or deleted?' when full_name like '%1' then 'refused' end as error from (select distinct full_name from a)""")
def written_sets(spark, sf_dir) -> DataFrame:
    """What a sink makes of the changes that takes four sets at once and refuses some names."""
    d = table(spark, sf_dir, "documents").where("n_chars >= 500")
    name = F.concat_ws("/", "source", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))

    def sink(batch):
        if len(batch) > 4:
            raise sync.TooLarge
        return {full_name: "refused" for _, full_name, _ in batch if full_name.endswith("1")}

    return sync.written(sync.applied(*remote(spark, sf_dir)), d.select(name.alias("full_name"), F.col("doc_id").cast("string").alias("repo_id")), sink)


@query("select lang as name, count(*) as size from documents where lang in ('en', 'de') group by 1")
def selected_categories(spark, sf_dir) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("size"))
    return filters.selected(sizes, [" EN ,de", "De"])


@query("select text as text, 'doc-' || doc_id as full_name from documents where text <> ''")
def embedded_texts(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return snapshots.embedded_texts(d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("full_name"), F.col("text").alias("readme")))


@query("""select n_name as full_name, case n_regionkey when 0 then ' ' when 1 then ' ' when 2 then null else 'about ' || n_name end as text,
case n_regionkey when 1 then 'unavailable' when 2 then 'failed' else 'fetched' end as outcome from nation""")
def fetched_texts(spark, sf_dir) -> DataFrame:
    """Texts of nations: of the first region they are empty, of two others they fail."""
    n = table(spark, sf_dir, "nation")
    region = {r["n_name"]: r["n_regionkey"] for r in n.collect()}  # 25 rows

    def fetch(name: str) -> str:
        if region[name] == 1:
            raise snapshots.Unavailable
        if region[name] == 2:
            raise TimeoutError
        return f"about {name}" if region[name] else ""

    return snapshots.fetched_texts(n.select(F.col("n_name").alias("full_name")), fetch, 4)


def _plan_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions as categories, suppliers as members by balance, customers in debt as unassigned."""
    cats = table(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + 1).alias("position"), F.col("r_name").alias("name"), F.lower("r_name").alias("description"), F.array("r_name", F.lower("r_name")).alias("terms"), (F.col("r_regionkey") / 4).alias("cohesion"), (F.col("r_regionkey") < 2).alias("exists")
    )
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    members = s.select((F.col("n_regionkey") + 1).alias("position"), F.row_number().over(Window.partitionBy("n_regionkey").orderBy("s_suppkey")).alias("at"), F.col("s_name").alias("full_name"), F.floor("s_acctbal").cast("int").alias("stars"), F.col("n_name").alias("description"), F.lit(0.25).alias("similarity"))
    c = table(spark, sf_dir, "customer").where("c_acctbal < -500")
    return cats, members, c.select(F.row_number().over(Window.orderBy("c_custkey")).alias("at"), F.col("c_name").alias("full_name"), F.lit(0).alias("stars"))


_PLAN_TABLES = """
m as (select n_regionkey + 1 as position, row_number() over (partition by n_regionkey order by s_suppkey) as "at", s_name as full_name, cast(floor(s_acctbal) as int) as stars, n_name as description from supplier join nation on s_nationkey = n_nationkey),
u as (select row_number() over (order by c_custkey) as "at", c_name as full_name from customer where c_acctbal < -500),
z as (select position, count(*) as n from m group by 1),
c as (select r_regionkey + 1 as position, r_name as name, r_regionkey / 4 as cohesion, r_regionkey < 2 as there, coalesce(n, 0) as n from region left join z on z.position = r_regionkey + 1)
"""
_LAST = 2**62


@query(f"""with {_PLAN_TABLES}
select 0 as section, 0 as "at", '# me: ' || ((select count(*) from m) + (select count(*) from u)) || ' records in ' || (select count(*) from c) || ' categories (lsa)' as line
union all select position + 1, 0, '## ' || name || ' (' || n || ')' || chr(10) || chr(10) || lower(name) from c
union all select position + 1, "at", '- ' || full_name || case when stars <= 0 then '' when stars < 1000 then ' `★' || stars || '`' else ' `★' || ((stars + 50) // 1000) || '.' || ((stars + 50) // 100 % 10) || 'k`' end || ' — ' || description from m
union all select {_LAST}, 0, '## Uncategorized (' || count(*) || ')' from u having count(*) > 0
union all select {_LAST}, "at", '- ' || full_name from u""")
def plan_markdown(spark, sf_dir) -> DataFrame:
    return plan.markdown(*_plan_tables(spark, sf_dir), "me", "lsa")


@query(f"""with {_PLAN_TABLES}
select position as section, 0 as "at", printf('  %-34s %3d repos  cohesion %.2f', name, n, cohesion) || case when there then '  (exists)' else '  (new)' end || chr(10) || repeat(' ', 37) || name || ', ' || lower(name) as line from c where position <= 3
union all select position, "at", case when "at" = 6 then '      … and ' || (n - 5) || ' more' else '      ' || rpad(full_name, 44, ' ') || ' 0.25' end from m join z using (position) where position <= 3 and "at" <= 6
union all select {_LAST}, 0, '  ' || count(*) || ' stars fit no category well enough to place:' from u having count(*) > 0
union all select {_LAST}, "at", case when "at" = 11 then '      … and ' || ((select count(*) from u) - 10) || ' more' else '      ' || full_name end from u where "at" <= 11
union all select {2**61}, 0, '  … and 2 more categories'""")
def plan_listing(spark, sf_dir) -> DataFrame:
    return plan.listing(*_plan_tables(spark, sf_dir), limit=3)


@query()
def readme_openings(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", readme_opening(120)(F.col("html")).alias("opening"))


@query()
def full_plan(spark, sf_dir) -> DataFrame:
    """The whole way for documents, with the defaults: terms, vectors, clusters, names, merges."""
    from .pipeline import build_plan

    return build_plan(document_corpus(spark, sf_dir))
