"""One query per operator of the corpus index, and the same as SQL.

Every query runs over whole tables. Batches of questions (cursors, names, typos) come from the symbols of each
twentieth file and are asked of all files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom import schema
from symloom.functions import text
from symloom.functions.paths import plain_path
from symloom.operators import corpus, dependencies, fuzzy, lookup, manifest, parse, resolve
from symloom.session import scratch, table
from symloom.sources.spread import spread

QUERIES: dict = {}
SQL: dict[str, str] = {}
STEP = 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _files(spark: SparkSession, d: str) -> DataFrame:
    return corpus.current_files(table(spark, d, "source_files"))


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return corpus.symbol_rows(table(spark, d, "symbols"))


def _once(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows, written to the shared folder and read from there."""
    place = scratch(rows.sparkSession, purpose)
    rows.write.parquet(place)
    return rows.sparkSession.read.parquet(place)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


#: Parts of SQL: current files, symbols, global symbols, lines, and the words of the asked files.
_F = "f as (select * exclude rn from (select *, row_number() over (partition by file_id order by mtime_ns desc, content_hash desc) as rn from source_files) where rn = 1)"
_S = "s as (select distinct * from symbols)"
_LOCAL = "(coalesce(depth, 0) > 0 and coalesce(def_keyword in ('variable', 'parameter', 'field'), false))"
_G = f"g as (select * from s where not {_LOCAL} and name is not null)"
_L = "l as (select file_id, i - 1 as line, regexp_replace(t, '\\r$', '') as text from (select file_id, unnest(string_split(content, chr(10))) as t, generate_subscripts(string_split(content, chr(10)), 1) as i from f))"
_IDENT = "[\\p{L}_][\\p{L}\\p{N}_]*"
_RUN = "[\\p{L}\\p{N}_]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = "array_to_string(list_filter(string_split(replace(rel_path, '\\', '/'), '/'), lambda s: s <> '' and s <> '.'), '/')"


def _w(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


# ---------------------------------------------------------------- sources and vocabulary


@query(f"select ext, {schema.sql_case(schema.FAMILY_OF, 'ext')} as family, count(*) as n from source_files group by all")
def lang_from_extension(spark, d):
    """Endings and their language families."""
    return table(spark, d, "source_files").groupBy("ext").agg(F.count(F.lit(1)).alias("n")).withColumn("family", corpus.family(F.col("ext")))


@query(
    f"""select skipped, count(*) as n from (select len(list_filter(string_split(regexp_replace(rel_path, '/?[^/]*$', ''), '/'),
        lambda s: s in {schema.sql_list(schema.SKIP_DIRS)} or starts_with(s, '.'))) > 0 as skipped from source_files) group by all"""
)
def skip_dirs(spark, d):
    """Files in directories that a scan passes over."""
    return table(spark, d, "source_files").groupBy(corpus.skipped_dir(F.col("rel_path")).alias("skipped")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select def_keyword, coalesce({schema.sql_case(schema.KIND_OF_KEYWORD, 'def_keyword')}, 'Unknown') as kind, count(*) as n from symbols group by all")
def kind_from_keyword(spark, d):
    """Kind of a symbol by its keyword."""
    c = schema.lookup(schema.KIND_OF_KEYWORD, F.col("def_keyword"))
    return table(spark, d, "symbols").groupBy("def_keyword").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.coalesce(c, F.lit("Unknown")))


@query(f"select def_keyword, coalesce({schema.sql_case(schema.KIND_OF_CAPTURE, 'def_keyword')}, 'Unknown') as kind, count(*) as n from symbols group by all")
def capture_kind(spark, d):
    """Kind by capture suffix."""
    c = schema.lookup(schema.KIND_OF_CAPTURE, F.col("def_keyword"))
    return table(spark, d, "symbols").groupBy("def_keyword").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.coalesce(c, F.lit("Unknown")))


@query(f"select kind, {schema.sql_case(schema.PROTOCOL_KIND, 'kind')} as protocol_kind, count(*) as n from symbols group by all")
def lsp_kind(spark, d):
    """Protocol name of each kind."""
    return table(spark, d, "symbols").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).withColumn("protocol_kind", schema.lookup(schema.PROTOCOL_KIND, F.col("kind")))


@query(_w(_S) + "select file_id, symbol_idx, case when container is not null then 1 else 0 end as default_depth from s")
def container_depth(spark, d):
    """Depth of a symbol whose scope is not known."""
    return _symbols(spark, d).select("file_id", "symbol_idx", F.when(F.col("container").isNotNull(), 1).otherwise(0).alias("default_depth"))


@query(
    _w(_F, _S)
    + f"""select file_id, symbol_idx, case {schema.sql_case(schema.FAMILY_OF, 'ext')}
  when 'go' then case when regexp_matches(name, '^[A-Z]') then 'Public' else 'Private' end
  when 'python' then case when starts_with(name, '_') then 'Private' else 'Public' end
  when 'ruby' then case when starts_with(name, '_') then 'Private' else 'Unknown' end else 'Unknown' end as visibility
from s join f using (file_id) where name is not null"""
)
def visibility_rules(spark, d):
    """Visibility by name, where the language has such a rule."""
    fam, name = corpus.family(F.col("ext")), F.col("name")
    private = F.when(name.startswith("_"), "Private")
    rule = F.when(fam == "go", F.when(name.rlike("^[A-Z]"), "Public").otherwise("Private")).when(fam == "python", F.coalesce(private, F.lit("Public"))).when(fam == "ruby", F.coalesce(private, F.lit("Unknown"))).otherwise("Unknown")
    return _symbols(spark, d).where("name is not null").join(_files(spark, d).select("file_id", "ext"), "file_id").select("file_id", "symbol_idx", rule.alias("visibility"))


_NOISE = " or ".join(f"({schema.sql_case(schema.FAMILY_OF, 'ext')} = '{k}' and word in {schema.sql_list(v)})" for k, v in schema.NOISE_WORDS.items())


@query(_w(_F, f"w as (select ext, unnest(regexp_extract_all(content, '{_IDENT}')) as word from f)") + f"select word, count(*) as n from w where {_NOISE} group by all")
def noise_words(spark, d):
    """Words that are never names, by language."""
    fam = corpus.family(F.col("ext"))
    noise = F.lit(False)
    for k, v in schema.NOISE_WORDS.items():
        noise = noise | ((fam == k) & F.col("word").isin(*v))
    return _files(spark, d).select("ext", F.explode(text.identifiers(F.col("content"))).alias("word")).where(noise).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- tokens


@query(
    f"""select doc_id, len(t) as tokens, len(list_distinct(t)) as distinct_tokens, coalesce(list_sum(list_transform(t, lambda x: length(x))), 0)::bigint as chars
from (select doc_id, coalesce(regexp_extract_all(text, '{_IDENT}'), []) as t from documents)"""
)
def tokens_per_document(spark, d):
    """Identifiers, distinct ones and their characters, per document."""
    t = _docs(spark, d).select("doc_id", F.coalesce(text.identifiers(F.col("text")), F.array().cast("array<string>")).alias("t"))
    chars = F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x))
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"), chars.alias("chars"))


@query(
    f"""with t as (select unnest(regexp_extract_all(text, '{_IDENT}')) as w from documents)
select count(*) as idents, count(*) filter (strlen(w) = length(w)) as ident_ascii, count(*) filter (strlen(w) <> length(w)) as ident_unicode,
 (select sum(strlen(text))::bigint from documents) as bytes, (select count(*) from documents) as calls from t"""
)
def token_counters(spark, d):
    """Counters of a scan for identifiers; whole texts are counted in the same pass."""
    per = _docs(spark, d).select(F.octet_length("text").alias("b"), F.coalesce(text.identifiers(F.col("text")), F.array().cast("array<string>")).alias("t"))
    ascii_ = F.size(F.filter("t", lambda w: F.octet_length(w) == F.char_length(w)))
    return per.select("b", F.size("t").alias("n"), ascii_.alias("a")).agg(
        F.sum("n").alias("idents"), F.sum("a").alias("ident_ascii"), F.sum(F.col("n") - F.col("a")).alias("ident_unicode"), F.sum("b").alias("bytes"), F.count(F.lit(1)).alias("calls")
    )


_RUNS = f"""t0 as (select file_id, line, unnest(regexp_extract_all(text, '{_RUN}')) as word, generate_subscripts(regexp_extract_all(text, '{_RUN}'), 1) as k,
  regexp_split_to_array(text, '{_RUN}') as seps from l where regexp_matches(text, '{_RUN}')),
r as (select file_id, word, line, cast(sum(strlen(seps[k])) over w - 0 + coalesce(sum(strlen(word)) over (w rows between unbounded preceding and 1 preceding), 0) as bigint) as col, strlen(word) as len
  from t0 window w as (partition by file_id, line order by k))"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _symbols(spark, d).where((F.col("file_id") % STEP == 0) & F.col("name").isNotNull()).select(F.col("name").alias("word")).distinct()


_ASKED = f"asked as (select distinct name as word from s where file_id % {STEP} = 0 and name is not null)"


@query(_w(_F, _S, _L, _RUNS, _ASKED) + "select word, file_id, line, col, len from r join asked using (word)")
def find_references(spark, d):
    """Word-boundary references of the asked names in the text of all files."""
    return lookup.references(_asked(spark, d), table(spark, d, "source_files"))


@query(
    _w(_F, _S, _L, _RUNS, _ASKED, f"p as (select distinct file_id, unnest(regexp_extract_all(content, '{_IDENT}')) as word from f)")
    + "select word, file_id, line, col, len from r join asked using (word) where (word, file_id) in (select (word, file_id) from p) or word not in (select word from p)"
)
def find_references_indexed(spark, d):
    """The same, with the posting lists asked first."""
    files = table(spark, d, "source_files")
    # postings of all deliveries: a file too many is scanned, none is missed
    p = files.select("file_id", F.explode(F.array_distinct(text.identifiers(F.col("content")))).alias("word"))
    return lookup.references(_asked(spark, d), files, p)


@query(_w(_F, _S, _L, _RUNS, _ASKED, "d as (select distinct file_id, line, col, name from s where name is not null)") + "select case when d.name is not null then 'Definition' else 'Reference' end as role, count(*) as n from r join asked using (word) left join d on r.file_id = d.file_id and r.line = d.line and r.col = d.col and r.word = d.name group by all")
def occurrence_roles(spark, d):
    """Whether an occurrence of an asked name defines it."""
    at = _symbols(spark, d).where("name is not null").select("file_id", "line", "col", F.col("name").alias("word"), F.lit("Definition").alias("role")).distinct()
    r = lookup.references(_asked(spark, d), table(spark, d, "source_files"))
    return r.join(at, ["file_id", "line", "col", "word"], "left").groupBy(F.coalesce("role", F.lit("Reference")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- indexes


@query(_w(_S, _G) + "select file_id, symbol_idx, name from g")
def definitions_index(spark, d):
    """Symbols other files may refer to."""
    return corpus.global_symbols(_symbols(spark, d)).select("file_id", "symbol_idx", "name")


@query(_w(_S, _G, _ASKED) + "select name, file_id, symbol_idx, line, col from g where name in (select word from asked)")
def definitions_lookup(spark, d):
    """Definitions of the asked names, in all files."""
    return lookup.definitions(_asked(spark, d).withColumnRenamed("word", "name"), corpus.global_symbols(_symbols(spark, d))).select("name", "file_id", "symbol_idx", "line", "col")


@query(_w(_F, _S, _G) + "select g.file_id, symbol_idx, name, rel_path from g join f using (file_id)")
def resolve_refs(spark, d):
    """Symbol references with their paths; dangling ones are dropped."""
    return corpus.global_symbols(_symbols(spark, d)).select("file_id", "symbol_idx", "name").join(_files(spark, d).select("file_id", "rel_path"), "file_id")


@query(_w(_S, _G) + f"select name, count(*) as definitions from g where file_id % {STEP} <> 0 group by all")
def unindex_file(spark, d):
    """The index after every twentieth file was taken out; names without a definition left are gone."""
    gone = _symbols(spark, d).where(F.col("file_id") % STEP == 0).select("file_id").distinct()
    return corpus.global_symbols(_symbols(spark, d)).join(gone, "file_id", "left_anti").groupBy("name").agg(F.count(F.lit(1)).alias("definitions"))


@query(f"with p as (select distinct worktree_key, {_PLAIN} as p from manifest) select worktree_key, p as rel_path, row_number() over (partition by worktree_key order by p) as file_no from p")
def file_ids(spark, d):
    """A dense number per path of each worktree."""
    paths = table(spark, d, "manifest").select("worktree_key", plain_path(F.col("rel_path")).alias("rel_path"))
    return corpus.dense_numbers(paths, "worktree_key", "rel_path", "file_no")


@query(_w(_F) + f"select word, count(distinct file_id) as files from (select file_id, unnest(regexp_extract_all(content, '{_IDENT}')) as word from f) group by all")
def postings(spark, d):
    """How many files hold each word."""
    return corpus.word_hash_sets(_files(spark, d)).select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("files"))


@query(_w(_F, _S, _ASKED) + f"select distinct word, file_id from (select file_id, unnest(regexp_extract_all(content, '{_IDENT}')) as word from f) join asked using (word)")
def postings_candidates(spark, d):
    """Files whose postings hold an asked name."""
    return corpus.word_hash_sets(_files(spark, d)).select(F.explode("words").alias("word"), "file_id").join(_asked(spark, d), "word")


@query(_w(_S) + "select name, count(distinct file_id) as files, count(*) as n from s where name is not null group by all")
def query_fixture_counts(spark, d):
    """Definitions and files per name."""
    s = _symbols(spark, d).where("name is not null").groupBy("name", "file_id").agg(F.count(F.lit(1)).alias("k"))
    return s.groupBy("name").agg(F.count(F.lit(1)).alias("files"), F.sum("k").alias("n"))


# ---------------------------------------------------------------- names


_NAMES = "s as (select distinct * from symbols), names as (select distinct name from s where name is not null), own as (select distinct name from s where name is not null and file_id % 20 = 0)"
#: In hexadecimal, as names may hold any characters.
_GRAM = f"""upper(hex(encode({_LOWER.format('name')})))"""
_GRAMS = f"""case when strlen(name) >= 3 then list_transform(range(0, strlen(name) - 2), lambda i: substring({_GRAM}, (i * 2 + 1)::int, 6)) else ['0000' || lpad(upper(to_hex(strlen(name))), 2, '0')] end"""
_TYPOS = "q as (select distinct substring(name, 2, 1) || substring(name, 1, 1) || substring(name, 3) as query from own where length(name) >= 4 union select 'zz' union select 'qqqqqqqq')"


def _names(spark: SparkSession, d: str) -> DataFrame:
    return _symbols(spark, d).where("name is not null").select("name").distinct()


def _own_names(spark: SparkSession, d: str) -> DataFrame:
    """The names of each twentieth file, which are asked of all."""
    return _asked(spark, d).select(F.col("word").alias("name"))


def _typos(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("name")
    swapped = _own_names(spark, d).where(F.char_length(n) >= 4).select(F.concat(F.substring(n, 2, 1), F.substring(n, 1, 1), F.expr("substring(name, 3)")).alias("query"))
    return swapped.unionAll(spark.createDataFrame([("zz",), ("qqqqqqqq",)], "query string")).distinct()


@query(_w(_NAMES) + f"select unnest({_GRAMS}) as gram, name from names")
def trigram_index(spark, d):
    """Entries of the trigram index."""
    return fuzzy.trigram_index(_names(spark, d))


_CAND = (
    f"ng as (select distinct unnest({_GRAMS}) as gram, name from names)",
    f"qg as (select distinct query, unnest({_GRAMS.replace('name', 'query')}) as gram from q where strlen(query) >= 3)",
    "shared as (select distinct query, name from qg join ng using (gram))",
    "cand as (select * from shared union all select query, name from q, names where query not in (select query from shared) and abs(strlen(query) - strlen(name)) <= 2)",
)


@query(_w(_NAMES, _TYPOS, *_CAND) + "select query, name from cand")
def trigram_candidates(spark, d):
    """Names that share a trigram with a query, or have its length where none does."""
    return fuzzy.candidates(_typos(spark, d), _names(spark, d))


@query(_w(_NAMES, _TYPOS, *_CAND) + "select query, name, levenshtein(query, name)::int as distance from cand where levenshtein(query, name) <= 2")
def fuzzy_search(spark, d):
    """Names within two edits of a query with its first letters swapped."""
    return fuzzy.fuzzy_matches(_typos(spark, d), _names(spark, d))


@query(_w(_NAMES) + f"select (select count(*) from names) as symbols, count(distinct gram) as trigrams, count(*) as entries from (select unnest({_GRAMS}) as gram from names)")
def index_counts(spark, d):
    """Sizes of the trigram index; repeats of a gram in one name count."""
    n = _names(spark, d)
    return fuzzy.trigram_index(n).agg(F.count_distinct("gram").alias("trigrams"), F.count(F.lit(1)).alias("entries")).withColumn("symbols", n.agg(F.count(F.lit(1))).scalar())


_PREFIX = "q as (select distinct upper(substring(name, 1, 4)) as query from own union select 'zzzz')"


def _prefixes(spark: SparkSession, d: str) -> DataFrame:
    return _own_names(spark, d).select(F.upper(F.substring("name", 1, 4)).alias("query")).unionAll(spark.createDataFrame([("zzzz",)], "query string")).distinct()


_COMPLETE = f"hits as (select query, name from q join names on starts_with({_LOWER.format('name')}, {_LOWER.format('query')}))"


@query(_w(_NAMES, _PREFIX, _COMPLETE, f"q2 as (select * from q where query not in (select query from hits))", *[c.replace(" from q,", " from q2,").replace("from q where", "from q2 where") for c in _CAND]) + "select * from hits union all select query, name from cand where levenshtein(query, name) <= 2")
def completion_prefix(spark, d):
    """Names that begin with a query, letter case apart, else what is alike."""
    return fuzzy.completions(_prefixes(spark, d), _names(spark, d))


_VIS = "case visibility when 'Public' then 2 when 'Private' then 0 else 1 end"


@query(_w(_NAMES, "q as (select distinct substring(name, 1, 1) || 'q' || substring(name, 3) as query from own where length(name) >= 4)", _COMPLETE, *_CAND) + "select query, name from cand where query not in (select query from hits) and levenshtein(query, name) <= 2")
def completion_fallback(spark, d):
    """Completions of words with a typo: all by the fallback."""
    n = F.col("name")
    q = _own_names(spark, d).where(F.char_length(n) >= 4).select(F.concat(F.substring(n, 1, 1), F.lit("q"), F.expr("substring(name, 3)")).alias("query")).distinct()
    c = fuzzy.completions(q, _names(spark, d))
    return c.where(~F.startswith(text.ascii_lower(F.col("name")), text.ascii_lower(F.col("query"))))


@query(
    _w(_NAMES, _G, _TYPOS, *[c.replace(" names", " gn") for c in ("gn as (select distinct name from g)", *_CAND)])
    + f"""select query, name, file_id, symbol_idx, visibility, rank from (select *, row_number() over (partition by query order by {_VIS} desc, name, file_id, symbol_idx) as rank
from (select query, name from cand where levenshtein(query, name) <= 2) join g using (name)) where rank <= 20"""
)
def workspace_symbol_top20(spark, d):
    """The first twenty definitions of what a query with a typo may mean, public ones first."""
    g = corpus.global_symbols(_symbols(spark, d))
    hits = fuzzy.fuzzy_matches(_typos(spark, d), g.select("name").distinct()).select("query", "name")
    rows = lookup.definitions(hits, g.select("name", "file_id", "symbol_idx", "visibility"))
    return lookup.top(rows, ["query"], [lookup.visibility_rank(F.col("visibility")).desc(), F.col("name"), F.col("file_id"), F.col("symbol_idx")], 20)


@query(
    _w(_S, _G, f"q as (select distinct file_id as here, substring(name, 1, 5) as query from s where file_id % {STEP} = 0 and length(name) >= 5)")
    + f"""select here, query, name, file_id, symbol_idx, score, rank from (select *, row_number() over (partition by here, query order by score desc, name, file_id, symbol_idx) as rank
from (select *, row_number() over (partition by here, query, name order by score desc, file_id, symbol_idx) as rn
 from (select *, case when file_id = here and visibility = 'Private' then 3 else {_VIS} end as score from g join q on starts_with({_LOWER.format('name')}, {_LOWER.format('query')})))
where rn = 1) where rank <= 20"""
)
def completion_top20(spark, d):
    """Completions seen from a file: its own private names first, then public ones; each name once, twenty per cursor."""
    s = _symbols(spark, d)
    # what several steps read is written once, so that no plan repeats what stands before
    g = _once(corpus.global_symbols(s).select("name", "file_id", "symbol_idx", "visibility"), "globals")
    q = s.where((F.col("file_id") % STEP == 0) & (F.char_length("name") >= 5)).select(F.col("file_id").alias("here"), F.substring("name", 1, 5).alias("query")).distinct()
    q = _once(q, "cursors")
    hits = _once(fuzzy.completions(q.select("query").distinct(), g.select("name").distinct()), "hits")
    score = F.when((F.col("file_id") == F.col("here")) & (F.col("visibility") == "Private"), 3).otherwise(lookup.visibility_rank(F.col("visibility")))
    # a name needs one definition per cursor: its best elsewhere is found once, and the twenty best names of each query,
    # before cursors multiply them; names of the cursor's own file, which may rank higher there, are joined for
    # themselves. A name outside of the twenty could only come in for one that stays, so none is missed
    key = [F.col("score").desc(), F.col("file_id"), F.col("symbol_idx")]
    best = lookup.top(g.withColumn("score", lookup.visibility_rank(F.col("visibility"))), ["name"], key, 1).drop("rank")
    last = [F.col("score").desc(), F.col("name"), F.col("file_id"), F.col("symbol_idx")]
    far = q.join(lookup.top(hits.join(best, "name"), ["query"], last, 20).drop("rank"), "query")
    # names of asking files alone meet the hits, and then their own cursors
    inside = g.withColumnRenamed("file_id", "here").join(q.select("here").distinct(), "here", "left_semi")
    own = hits.join(inside, "name").join(q, ["here", "query"]).withColumn("file_id", F.col("here"))
    own = own.withColumn("score", score)
    rows = far.select("here", "query", "name", "file_id", "symbol_idx", "score").unionByName(own.select("here", "query", "name", "file_id", "symbol_idx", "score"))
    once = lookup.top(rows, ["here", "query", "name"], key, 1).drop("rank")
    return lookup.top(once, ["here", "query"], last, 20)


# ---------------------------------------------------------------- scopes


@query(_w(_S) + "select file_id, name, count(*) as n from s where coalesce(depth, 0) > 0 and name is not null group by all")
def local_definitions(spark, d):
    """Definitions inside a scope, per file and name."""
    return _symbols(spark, d).where((F.coalesce("depth", F.lit(0)) > 0) & F.col("name").isNotNull()).groupBy("file_id", "name").agg(F.count(F.lit(1)).alias("n"))


_SCOPED = f"sc as (select file_id, symbol_idx, name, line, scope_end_line, depth from s where name is not null and depth > 0)"
_CURS = f"c as (select file_id, symbol_idx as cur, name, line + 2 as cursor_line from s where name is not null)"


@query(
    _w(_S, _SCOPED, _CURS)
    + """select file_id, cur, arg_max(line, (depth, line, symbol_idx)) as line, arg_max(symbol_idx, (depth, line, symbol_idx)) as symbol_idx
from c join (select file_id, name, symbol_idx, line, scope_end_line, depth from sc) x using (file_id, name)
where line <= cursor_line and (scope_end_line is null or cursor_line <= scope_end_line) group by all"""
)
def local_definition_asof(spark, d):
    """The innermost definition whose scope holds a cursor two lines below each symbol."""
    s = _symbols(spark, d).where("name is not null")
    scoped = s.select("file_id", "symbol_idx", "name", "line", "scope_end_line", "depth")
    cursors = s.select(F.struct("file_id", F.col("symbol_idx").alias("cur")).alias("cursor_id"), "file_id", "name", (F.col("line") + 2).alias("cursor_line"))
    return lookup.local_definition_at(cursors, scoped).select("cursor_id.file_id", "cursor_id.cur", "line", "symbol_idx")


@query(
    _w(_S)
    + """select a.file_id, a.symbol_idx, count(*) as depth, arg_max({'n': b.name}, (b.line, -b.scope_end_line, b.symbol_idx)).n as container
from s a join s b on a.file_id = b.file_id and b.scope_end_line is not null and b.line <= a.line and a.line <= b.scope_end_line group by all"""
)
def enclosing_scope(spark, d):
    """How many scopes enclose a symbol's line, and the name of the innermost."""
    s = _symbols(spark, d)
    scopes = s.where("scope_end_line is not null").select("file_id", F.col("line").alias("start"), F.col("scope_end_line").alias("end"), F.col("symbol_idx").alias("last"), F.struct("symbol_idx", "name").alias("scope"))
    points = s.select(F.struct("file_id", "symbol_idx").alias("point_id"), "file_id", F.col("line").alias("at"))
    return lookup.enclosing_scopes(points, scopes).select("point_id.file_id", "point_id.symbol_idx", "depth", F.col("container.name").alias("container"))


@query(_w(_S) + "select file_id, line, col, symbol_idx from (select *, row_number() over (partition by file_id, line, col order by container is not null desc, symbol_idx desc) as rn from s) where rn = 1")
def dedup_same_position(spark, d):
    """One of several symbols at a position: one with a container, else the last."""
    return lookup.same_position_once(_symbols(spark, d).select("file_id", "line", "col", "symbol_idx", "container"), "symbol_idx").drop("container")


@query(_w(_S) + "select file_id, symbol_idx, name, kind, line, col, container from s")
def outline(spark, d):
    """All symbols of each file, in source order by symbol_idx."""
    return _symbols(spark, d).select("file_id", "symbol_idx", "name", "kind", "line", "col", "container")


@query(_w(_S) + f"select file_id, symbol_idx, name, kind from s where not {_LOCAL}")
def outline_filtered(spark, d):
    """The outline without locals."""
    return lookup.outline(_symbols(spark, d)).select("file_id", "symbol_idx", "name", "kind")


# ---------------------------------------------------------------- cursors and ranking


_CUR = (
    f"k as (select s.file_id, symbol_idx, l.text, s.col + 1 as col from s join l on s.file_id = l.file_id and s.line = l.line)",
    f"""cw as (select file_id, symbol_idx, text, col, case when col <= length(text) then regexp_extract(substring(text, 1, col), '[\\p{{L}}\\p{{N}}_]*$') || regexp_extract(substring(text, col + 1), '^[\\p{{L}}\\p{{N}}_]*') end as word,
  regexp_extract(regexp_replace(substring(text, 1, col), '[\\p{{L}}\\p{{N}}_]+$', ''), '([\\p{{L}}\\p{{N}}_]+) *(::|->|\\.)$', 1) as q from k)""",
)


def _cursors(spark: SparkSession, d: str) -> DataFrame:
    """A cursor one character into the name of each symbol: (file_id, symbol_idx, text, col, word, qualifier)."""
    s = _symbols(spark, d).select("file_id", "symbol_idx", "line", (F.col("col") + 1).alias("col"))
    at = s.join(corpus.lines(_files(spark, d), "file_id"), ["file_id", "line"])
    return at.select("file_id", "symbol_idx", "text", "col", text.word_at(F.col("text"), F.col("col")).alias("word"), text.qualifier_before(text.word_prefix(F.col("text"), F.col("col"))).alias("qualifier"))


@query(_w(_F, _S, _L, *_CUR) + "select file_id, symbol_idx, nullif(word, '') as word from cw")
def word_at_position(spark, d):
    """The word under a cursor."""
    return _cursors(spark, d).select("file_id", "symbol_idx", "word")


@query(_w(_F, _S, _L, *_CUR) + "select file_id, symbol_idx, nullif(q, '') as qualifier from cw where col <= length(text)")
def qualifier_before(spark, d):
    """What qualifies the word under a cursor."""
    return _cursors(spark, d).where(F.col("col") <= F.char_length("text")).select("file_id", "symbol_idx", "qualifier")


#: Each twentieth file's names, asked from that file, qualified by the container of the definition there if it has one.
_RANKQ = f"rq as (select file_id as here, name, max(container) as qualifier from g where file_id % {STEP} = 0 group by all)"
_OPEN = f"""op as (select file_id, line as opl, regexp_extract(text, '^\\s*(?:impl|struct|class|trait|enum|interface|object)\\s*(?:<[^>]*>\\s*)?({_RUN})', 1) as qualifier from l)"""
_RANK = (
    "rd as (select here, rq.qualifier, g.* from rq join g using (name))",
    "src as (select distinct here, name, rd.file_id, symbol_idx from rd join op on rd.file_id = op.file_id and rd.qualifier = op.qualifier where container is null and op.qualifier <> '' and opl < line and opl >= line - 30)",
    """ranked as (select rd.here, rd.name, rd.file_id, rd.symbol_idx, rd.line, rd.visibility, case when rd.file_id = rd.here then 2 else 0 end
 + case when coalesce(case when qualifier is not null and container is not null then container = qualifier end, src.here is not null) then 4 else 0 end as score,
 row_number() over (partition by rd.here, rd.name order by case when rd.file_id = rd.here then 2 else 0 end
 + case when coalesce(case when qualifier is not null and container is not null then container = qualifier end, src.here is not null) then 4 else 0 end desc, rd.file_id, rd.line, rd.col, rd.symbol_idx) as rank
 from rd left join src on rd.here = src.here and rd.name = src.name and rd.file_id = src.file_id and rd.symbol_idx = src.symbol_idx)""",
)


def _openers(spark: SparkSession, d: str) -> DataFrame:
    """Written once, as several rankings ask it."""
    return _once(lookup.openers(table(spark, d, "source_files")), "openers")


def _rank_asked(g: DataFrame) -> DataFrame:
    return g.where(F.col("file_id") % STEP == 0).groupBy(F.col("file_id").alias("here"), "name").agg(F.max("container").alias("qualifier"))


def _ranked(spark: SparkSession, d: str, extra=None) -> DataFrame:
    g = corpus.global_symbols(_symbols(spark, d)).select("file_id", "symbol_idx", "name", "line", "col", "container", "visibility")
    q = _rank_asked(g)
    defs = q.join(g, "name").withColumn("query_id", F.struct("here", "name")).withColumn("current_file", F.col("here"))
    if extra is not None:
        lang = _files(spark, d).select("file_id", corpus.family(F.col("ext")).alias("lang"))
        defs = defs.join(lang, "file_id", "left").join(lang.select(F.col("file_id").alias("here"), F.col("lang").alias("here_lang")), "here", "left")
    return lookup.rank(defs, lookup.qualifier_in_source(defs, _openers(spark, d)), extra)


@query(_w(_F, _S, _G, _L, _RANKQ, _OPEN, *_RANK) + "select here, name, file_id, symbol_idx, score, rank from ranked")
def rank_definitions(spark, d):
    """Definitions of a name in the order of the asking file and the qualifier."""
    g = _once(corpus.global_symbols(_symbols(spark, d)).select("file_id", "symbol_idx", "name", "line", "col", "container"), "globals")
    return lookup.rank_all(_once(_rank_asked(g), "asked"), g, _openers(spark, d))


#: Cursors in each twentieth file: in the name of each symbol, and in the last word of the line after it; with what stands around.
_LAST_WORD = r"(?s)^(.*[^\p{L}\p{N}_])?([\p{L}_][\p{L}\p{N}_]*)([^\p{L}\p{N}_]*)$"
_AROUND = (
    f"own as (select * from s where file_id % {STEP} = 0)",
    """c0 as (select own.file_id as here, symbol_idx, 0 as k, own.line as cl, regexp_replace(substring(text, 1, col + 1), '[\\p{L}\\p{N}_]+$', '') as before,
  regexp_extract(substring(text, 1, col + 1), '[\\p{L}\\p{N}_]*$') || regexp_extract(substring(text, col + 2), '^[\\p{L}\\p{N}_]*') as name, regexp_replace(substring(text, col + 2), '^[\\p{L}\\p{N}_]*', '') as after
  from own join l on own.file_id = l.file_id and own.line = l.line where col + 1 <= length(text))""",
    f"""c1 as (select own.file_id as here, symbol_idx, 1 as k, l.line as cl, regexp_extract(text, '{_LAST_WORD}', 1) as before, regexp_extract(text, '{_LAST_WORD}', 2) as name, regexp_extract(text, '{_LAST_WORD}', 3) as after
  from own join l on own.file_id = l.file_id and own.line + 1 = l.line)""",
    """cur as (select c.*, nullif(regexp_extract(before, '([\\p{L}\\p{N}_]+) *(::|->|\\.)$', 1), '') as qualifier,
  case when regexp_matches(rtrim(before), '(^|[^.])\\.$') or (ends_with(rtrim(before), '->') and ext not in ('rs', 'py', 'pyi')) then 'FieldAccess'
   when starts_with(ltrim(after), '(') then 'FunctionCall'
   when regexp_matches(rtrim(before), '((^|[^\\p{L}\\p{N}_])(struct|enum|class|impl|new|extends|implements|interface|trait|union|dyn)|[^:]:|->)$') then 'TypeRef' else 'Plain' end as context
  from (select * from c0 union all select * from c1) c join f on f.file_id = here where name <> '')""",
)


def _around(spark: SparkSession, d: str, step: int = STEP) -> DataFrame:
    """The same: (query_id, here, at, name, qualifier, context)."""
    s = _symbols(spark, d).where(F.col("file_id") % step == 0).select("file_id", "symbol_idx", "line", (F.col("col") + 1).alias("col"))
    lines = corpus.lines(_files(spark, d).where(F.col("file_id") % step == 0), "file_id", "ext")
    t = F.col("text")
    on_name = s.join(lines, ["file_id", "line"]).where(F.col("col") <= F.char_length(t))
    on_name = on_name.select(
        "file_id", "symbol_idx", F.lit(0).alias("k"), "line", "ext", text.word_prefix(t, F.col("col")).alias("before"), text.word_at(t, F.col("col")).alias("name"),
        F.regexp_replace(F.substring(t, F.col("col") + 1, F.char_length(t)), rf"^{text.RUN}", "").alias("after"),
    )
    below = s.select("file_id", "symbol_idx", (F.col("line") + 1).alias("line")).join(lines, ["file_id", "line"])
    part = lambda n: F.regexp_extract(t, _LAST_WORD, n)
    below = below.select("file_id", "symbol_idx", F.lit(1).alias("k"), "line", "ext", part(1).alias("before"), part(2).alias("name"), part(3).alias("after"))
    both = on_name.unionAll(below).where(F.col("name") != "")
    context = text.ident_context(F.col("before"), F.col("after"), F.col("ext").isin("rs", "py", "pyi"))
    return both.select(F.struct("file_id", "symbol_idx", "k").alias("query_id"), F.col("file_id").alias("here"), F.col("line").alias("at"), "name", text.qualifier_before(F.col("before")).alias("qualifier"), context.alias("context"))


_DEPS = f"dep as (select file_id from f where regexp_matches(rel_path, '{dependencies._DIR}'))"


def _resolved_sql(local: int) -> str:
    """All candidates of all cursors, their ranks, and the first of the first kind that has any."""
    match = "case when qualifier is not null and container is not null then container = qualifier else exists (select 1 from op where op.file_id = x.file_id and op.qualifier = x.qualifier and x.container is null and opl < x.line and opl >= x.line - 30) end"
    return _w(
        _F, _S, _G, _L, _OPEN, _DEPS, *_AROUND,
        "ws as (select * from g where file_id not in (select file_id from dep))", "dp as (select * from g where file_id in (select file_id from dep))",
        f"""x as (
 select cur.here, cur.symbol_idx as cur, k, qualifier, 1 as priority, ws.file_id, ws.symbol_idx, line, col, container from cur join ws using (name)
 union all select here, cur.symbol_idx, k, qualifier, 2, dp.file_id, dp.symbol_idx, line, col, container from cur join dp using (name) where context in ('FunctionCall', 'Plain')
 union all select here, cur.symbol_idx, k, qualifier, 0, s.file_id, s.symbol_idx, line, col, container from cur join s using (name) where context = 'FieldAccess' and s.file_id = here and depth > 0 and def_keyword = 'field'
 union all select here, cur, k, qualifier, {local}, here, m.i, m.l, m.c, m.container from (select here, cur.symbol_idx as cur, k, qualifier,
   arg_max({{'i': s.symbol_idx, 'l': line, 'c': col, 'container': container}}, (depth, line, s.symbol_idx)) as m from cur join s using (name)
   where context in ('FunctionCall', 'Plain') and s.file_id = here and depth > 0 and line <= cl and (scope_end_line is null or cl <= scope_end_line) group by all))""",
        f"y as (select *, case when file_id = here then 2 else 0 end + case when coalesce({match}, false) then 4 else 0 end as score from x)",
        "z as (select *, row_number() over (partition by here, cur, k order by priority, score desc, file_id, line, col, symbol_idx) as rank from y)",
    )


@query(_resolved_sql(resolve.LOCAL_FIRST) + "select here, cur, k, priority, file_id, symbol_idx, line from z where rank = 1")
def goto_definition(spark, d):
    """The definition meant at each cursor: by its context a field, the local in scope, the workspace, dependencies."""
    return _resolve(spark, d, True)


@query(_resolved_sql(resolve.LOCAL_LAST) + "select here, cur, k, priority, file_id, symbol_idx, line from z where rank = 1")
def hover_precedence(spark, d):
    """What a hover is about: as for a definition, but locals come after the workspace and dependencies."""
    return _resolve(spark, d, False)


@query(
    _resolved_sql(resolve.LOCAL_LAST)
    + """select here, cur, k, concat_ws(chr(10) || chr(10), case when signature is not null then '```' || chr(10) || signature || chr(10) || '```' end,
 case when coalesce(depth, 0) = 0 then doc_comment else 'Type: `' || doc_comment || '`' end) as markdown from z join s using (file_id, symbol_idx) where rank = 1"""
)
def hover_info(spark, d):
    """What a hover shows at each cursor."""
    s = _symbols(spark, d).select("file_id", "symbol_idx", "signature", "doc_comment", "depth")
    return _resolve(spark, d, False).join(s, ["file_id", "symbol_idx"]).select("here", "cur", "k", _markdown())


def _dependencies(spark: SparkSession, d: str) -> DataFrame:
    return dependencies.package_files(_files(spark, d).select("file_id", "worktree_key", "rel_path"))


def _resolve(spark: SparkSession, d: str, local_first: bool) -> DataFrame:
    cursors = _once(_around(spark, d), "cursors")  # a few columns each, asked by each kind of candidate
    found = resolve.resolve(cursors, _symbols(spark, d), _dependencies(spark, d), _openers(spark, d), local_first)
    return found.select(F.col("query_id.file_id").alias("here"), F.col("query_id.symbol_idx").alias("cur"), "query_id.k", "priority", "file_id", "symbol_idx", "line")


_FAM = schema.sql_case(schema.FAMILY_OF, "ext")


@query(
    _w(_F, _S, _G, _L, _RANKQ, _OPEN, *_RANK, f"fl as (select file_id, {_FAM} as lang from f)")
    + "select here, name, ranked.file_id, symbol_idx, score + case when a.lang = b.lang then 1 else 0 end as score from ranked left join fl a using (file_id) left join fl b on b.file_id = here"
)
def import_ranking(spark, d):
    """The optional extension: one more point for a definition in the same language."""
    same = F.when(F.col("lang") == F.col("here_lang"), 1).otherwise(0)
    return _ranked(spark, d, same).select("here", "name", "file_id", "symbol_idx", "score")


# ---------------------------------------------------------------- text scalars


@query("select doc_id, strlen(text) as utf8, length(text) as utf32, length(text) + length(regexp_replace(text, '[\\x{0}-\\x{FFFF}]', '', 'g')) as utf16 from documents where text is not null")
def position_encodings(spark, d):
    """Lengths of a text in the three position encodings."""
    t = F.col("text")
    return _docs(spark, d).where(t.isNotNull()).select("doc_id", F.octet_length(t).cast("long").alias("utf8"), F.char_length(t).cast("long").alias("utf32"), text.utf16_length(t).cast("long").alias("utf16"))


@query(_w(_S) + f"select distinct name, {_LOWER.format('name')} as lower_name from s where name is not null")
def ascii_lower(spark, d):
    """Names in ASCII lower case."""
    return _symbols(spark, d).where("name is not null").select("name", text.ascii_lower(F.col("name")).alias("lower_name")).distinct()


@query(f"select distinct rel_path, {_PLAIN} as plain from manifest")
def rel_paths(spark, d):
    """Plain spellings of paths."""
    return table(spark, d, "manifest").select("rel_path", plain_path(F.col("rel_path")).alias("plain")).distinct()


_URLS = "u as (select worktree_key, unnest(['git@Host.Example:' || substring(working_dir, 2) || '.git', ' https://Host.Example' || working_dir || '/', 'https://host.example' || working_dir || '.git/']) as url from worktrees)"


@query(_w(_URLS, "t as (select worktree_key, url, regexp_replace(regexp_replace(trim(url), '/+$', ''), '\\.git$', '') as u from u)") + "select worktree_key, url, lower(regexp_replace(u, '^git@([^:]*):', 'https://\\1/')) as remote from t")
def normalize_urls(spark, d):
    """One spelling per remote."""
    w, h = F.col("working_dir"), F.lit("git@Host.Example:")
    urls = F.array(F.concat(h, F.expr("substring(working_dir, 2)"), F.lit(".git")), F.concat(F.lit(" https://Host.Example"), w, F.lit("/")), F.concat(F.lit("https://host.example"), w, F.lit(".git/")))
    return table(spark, d, "worktrees").select("worktree_key", F.explode(urls).alias("url")).select("worktree_key", "url", text.normalize_remote(F.col("url")).alias("remote"))


@query(
    _w(_S, "n as (select distinct name, hex(name) as h from s where name is not null)")
    + "select name, list_reduce(list_prepend(2166136261::hugeint, list_transform(range(0, strlen(name)), lambda i: ('0x' || substring(h, (2 * i + 1)::int, 2))::int::hugeint)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)::bigint as word_hash from n"
)
def word_hash_fnv1a(spark, d):
    """Word hashes of all names."""
    return _symbols(spark, d).where("name is not null").select("name").distinct().select("name", text.fnv1a(F.col("name")).alias("word_hash"))


@query("select sha256(content) as content_hash, count(*) as n, count(distinct file_id) as files from source_files group by all")
def content_hash_dedup(spark, d):
    """Distinct contents and how often each is delivered."""
    c = table(spark, d, "source_files").select(F.sha2("content", 256).alias("content_hash"), "file_id").groupBy("content_hash", "file_id").agg(F.count(F.lit(1)).alias("k"))
    return c.groupBy("content_hash").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("files"))


@query(_w(_S) + "select file_id, symbol_idx, case when coalesce(depth, 0) = 0 then doc_comment end as doc, coalesce(signature, name) as signature from s")
def enriched_symbols(spark, d):
    """Documentation only of symbols at the top level; a signature only where one is missing."""
    return _symbols(spark, d).select("file_id", "symbol_idx", F.when(F.coalesce("depth", F.lit(0)) == 0, F.col("doc_comment")).alias("doc"), F.coalesce("signature", "name").alias("signature"))


@query()
def parameters(spark, d):
    """Parameters of each signature, split outside of brackets."""
    return _symbols(spark, d).where("signature is not null").select("file_id", "symbol_idx", text.parameters(F.col("signature")).alias("parameters"))


@query(_w(_F, _S, _L) + "select s.file_id, symbol_idx, s.col as start_byte, s.col + strlen(name) as end_byte, length(l.text) as line_chars from s left join l on s.file_id = l.file_id and s.line = l.line where name is not null")
def symbol_ranges(spark, d):
    """Where a symbol's name stands in its line; raw columns, and no length where the line is gone."""
    s = _symbols(spark, d).where("name is not null").select("file_id", "symbol_idx", "line", F.col("col").cast("long").alias("start_byte"), (F.col("col") + F.octet_length("name")).cast("long").alias("end_byte"))
    return s.join(corpus.lines(_files(spark, d), "file_id").select("file_id", "line", F.char_length("text").cast("long").alias("line_chars")), ["file_id", "line"], "left").drop("line")


@query(_w(_S) + f"select file_id, symbol_idx, name, {schema.sql_case(schema.PROTOCOL_KIND, 'kind')} as kind, line, col, col + strlen(name) as end_col, container as container_name from s where not {_LOCAL} and name is not null")
def document_symbol_response(spark, d):
    """What a file's outline answers."""
    k = schema.lookup(schema.PROTOCOL_KIND, F.col("kind"))
    return lookup.outline(_symbols(spark, d)).where("name is not null").select("file_id", "symbol_idx", "name", k.alias("kind"), "line", "col", (F.col("col") + F.octet_length("name")).cast("long").alias("end_col"), F.col("container").alias("container_name"))


@query(_w(_F, _S, _L, _RUNS, _ASKED) + "select rel_path, word, line, col, col + len as end_col from r join asked using (word) join f using (file_id)")
def references_response(spark, d):
    """References with their paths and ranges."""
    r = lookup.references(_asked(spark, d), table(spark, d, "source_files"))
    return r.join(_files(spark, d).select("file_id", "rel_path"), "file_id").select("rel_path", "word", "line", "col", (F.col("col") + F.col("len")).cast("long").alias("end_col"))


# ---------------------------------------------------------------- incremental state

_KEYS = ["worktree_key", "rel_path"]
_SNAP = f"""st as (select * exclude rn from (select snapshot_id, worktree_key, {_PLAIN} as rel_path, lower(content_hash) as content_hash, size, mtime_ns, generation,
  row_number() over (partition by snapshot_id, worktree_key, {_PLAIN} order by generation desc, lower(content_hash), mtime_ns, size) as rn from manifest_snapshot) where rn = 1),
ids as (select max(snapshot_id) as last, (select max(snapshot_id) from manifest_snapshot where snapshot_id < (select max(snapshot_id) from manifest_snapshot)) as prev from manifest_snapshot),
new as (select * exclude snapshot_id from st where snapshot_id = (select last from ids)), old as (select * exclude snapshot_id from st where snapshot_id = (select prev from ids))"""
_UNITS = "un as (select distinct lower(content_hash) as content_hash from file_units where parser_version = 7)"
_CLASS = """cl as (select new.worktree_key, new.rel_path, new.content_hash, new.size, case when new.size = old.size and new.mtime_ns = old.mtime_ns and old.content_hash in (select content_hash from un) then 'FRESH'
 when new.content_hash in (select content_hash from un) then 'REUSE' else 'PARSE' end as status from new left join old using (worktree_key, rel_path))"""


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The last two snapshots, one row per file."""
    m = table(spark, d, "manifest_snapshot").select("snapshot_id", "worktree_key", plain_path(F.col("rel_path")).alias("rel_path"), F.lower("content_hash").alias("content_hash"), "size", "mtime_ns", "generation")
    ids = m.select("snapshot_id").distinct().orderBy(F.col("snapshot_id").desc()).limit(2)
    place = ids.withColumn("_k", F.row_number().over(Window.orderBy(F.col("snapshot_id").desc())))
    w = Window.partitionBy("snapshot_id", *_KEYS).orderBy(F.col("generation").desc(), "content_hash", "mtime_ns", "size")
    one = m.join(place, "snapshot_id").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "snapshot_id")
    return one.where("_k = 1").drop("_k"), one.where("_k = 2").drop("_k")


def _units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_units").where("parser_version = 7").select(F.lower("content_hash").alias("content_hash")).distinct()


@query(_w(_SNAP, _UNITS, _CLASS) + "select worktree_key, rel_path, status from cl")
def manifest_classify(spark, d):
    """Which files of the last snapshot are fresh, have a stored unit, or must be parsed."""
    new, old = _two(spark, d)
    return manifest.classify(new, old, _units(spark, d), _KEYS).select(*_KEYS, "status")


@query(_w(_SNAP) + "select coalesce(new.worktree_key, old.worktree_key) as worktree_key, coalesce(new.rel_path, old.rel_path) as rel_path, coalesce(new.content_hash, old.content_hash) as content_hash, case when new.rel_path is not null then new.generation else old.generation end as generation from old full outer join new on old.worktree_key = new.worktree_key and old.rel_path = new.rel_path")
def manifest_upsert(spark, d):
    """The snapshot before with the rows of the last put in."""
    new, old = _two(spark, d)
    return manifest.upsert(old, new, _KEYS).select(*_KEYS, "content_hash", "generation")


@query(_w(_SNAP) + "select worktree_key, rel_path from old anti join new using (worktree_key, rel_path)")
def dead_rows(spark, d):
    """Rows of the snapshot before whose files are gone."""
    new, old = _two(spark, d)
    return manifest.dead_rows(old, new, _KEYS).select(*_KEYS)


@query("select parser_version = (select max(parser_version) from file_units) as current, count(*) as units from file_units group by all")
def parser_version_gate(spark, d):
    """Units of the current parser version, and of versions that no longer hold."""
    u = table(spark, d, "file_units")
    return u.groupBy((F.col("parser_version") == u.agg(F.max("parser_version")).scalar()).alias("current")).agg(F.count(F.lit(1)).alias("units"))


@query(
    _w(_SNAP, _UNITS, _CLASS)
    + """select count(*) as stat_calls, coalesce(sum(case when status <> 'FRESH' then size end), 0)::bigint as bytes_read, count(*) filter (status <> 'FRESH') as hashed,
 count(distinct case when status = 'PARSE' then content_hash end) as parsed, count(distinct case when status = 'PARSE' then content_hash end) as store_writes,
 count(*) - count(distinct case when status = 'PARSE' then content_hash end) as store_hits,
 count(distinct case when status = 'PARSE' then content_hash end) / count(*) as reparse_ratio, 1 - count(*) filter (status <> 'FRESH') / count(*) as hash_savings from cl"""
)
def scan_metrics(spark, d):
    """Counters of scanning the last snapshot."""
    new, old = _two(spark, d)
    return manifest.scan_metrics(manifest.classify(new, old, _units(spark, d), _KEYS))


_SCEN = """sc as (select 'cold' as scenario, 'PARSE' as status, content_hash, size from new union all select 'rescan', 'FRESH', content_hash, size from new
 union all select 'clone', 'REUSE', content_hash, size from new union all select 'edit', case when new.content_hash = old.content_hash then 'FRESH' when old.content_hash is null or new.content_hash not in (select content_hash from old) then 'PARSE' else 'REUSE' end, new.content_hash, new.size from new left join old using (worktree_key, rel_path))"""


@query(_w(_SNAP, _SCEN) + "select scenario, count(*) as files, count(*) filter (status <> 'FRESH') as hashed, count(distinct case when status = 'PARSE' then content_hash end) as parsed from sc group by all")
def cache_scenarios(spark, d):
    """Work of a cold scan, a rescan, a second clone and a scan after edits."""
    new, old = _two(spark, d)
    stored = new.select("content_hash")
    none = stored.where(F.lit(False))
    still = manifest.classify(new.withColumn("mtime_ns", F.lit(0).cast("long")).withColumn("size", F.lit(0).cast("long")), old.where(F.lit(False)), stored, _KEYS)
    same = old.select(*_KEYS, F.col("content_hash").alias("o")).join(new, _KEYS, "right")
    same = same.join(old.select("content_hash").distinct().withColumn("_has", F.lit(True)), "content_hash", "left")
    edit = same.withColumn("status", F.when(F.col("content_hash") == F.col("o"), "FRESH").when(F.col("o").isNull() | F.col("_has").isNull(), "PARSE").otherwise("REUSE"))
    runs = {"cold": manifest.classify(new, old.where(F.lit(False)), none, _KEYS), "rescan": manifest.classify(new, new, stored, _KEYS), "clone": still, "edit": edit}
    out = None
    for name, c in runs.items():
        c = c.select(F.lit(name).alias("scenario"), "status", "content_hash")
        out = c if out is None else out.unionAll(c)
    per = out.groupBy("scenario", "content_hash").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("status") != "FRESH", 1).otherwise(0)).alias("h"), F.max(F.when(F.col("status") == "PARSE", 1).otherwise(0)).alias("p"))
    return per.groupBy("scenario").agg(F.sum("n").alias("files"), F.sum("h").alias("hashed"), F.sum("p").alias("parsed"))


_M = f"m as (select worktree_key, {_PLAIN} as rel_path, lower(content_hash) as content_hash, generation from manifest)"


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest").select("worktree_key", plain_path(F.col("rel_path")).alias("rel_path"), F.lower("content_hash").alias("content_hash"), "generation")


_DEEP = "deep as (select worktree_key as here_key, working_dir || '/lib' as here_dir from worktrees)"


@query(
    _w(_M, "h as (select 'parent' as here_key, d as here_dir from (select distinct regexp_extract(working_dir, '^/[^/]+', 0) as d from worktrees))")
    + """select here_dir, rel_path, generation from (select here_dir, substring(working_dir, length(here_dir) + 2) || '/' || rel_path as rel_path, generation,
 row_number() over (partition by here_dir, substring(working_dir, length(here_dir) + 2) || '/' || rel_path order by generation desc) as rn
 from m join worktrees using (worktree_key) join h on starts_with(working_dir, here_dir || '/')) where rn = 1"""
)
def subsume_parent(spark, d):
    """Rows for a parent of indexed worktrees: their paths get the way down to them."""
    w = table(spark, d, "worktrees")
    here = w.select(F.regexp_extract("working_dir", "^/[^/]+", 0).alias("here_dir")).distinct().withColumn("here_key", F.concat(F.lit("parent"), "here_dir"))
    out = manifest.subsume(_manifest(spark, d), here, w)
    return out.join(here, "here_key").select("here_dir", "rel_path", "generation")


@query(
    _w(_M, _DEEP)
    + """select here_dir, rel_path, generation from (select here_dir, substring(rel_path, 5) as rel_path, generation, row_number() over (partition by here_key, rel_path order by generation desc) as rn
 from m join worktrees w using (worktree_key) join deep on here_dir = working_dir || '/lib' where starts_with(rel_path, 'lib/')) where rn = 1"""
)
def subsume_child(spark, d):
    """Rows for a subdirectory of an indexed worktree: those below it, without the way."""
    w = table(spark, d, "worktrees")
    here = w.select(F.concat(F.lit("child"), "worktree_key").alias("here_key"), F.concat("working_dir", F.lit("/lib")).alias("here_dir"))
    return manifest.subsume(_manifest(spark, d), here, w).join(here, "here_key").select("here_dir", "rel_path", "generation")


_EDITS = f"ed as (select file_id, 'edited ' || file_id as content from f where file_id % {STEP} = 0 union all select -1, 'new')"


def _edits(spark: SparkSession, d: str) -> DataFrame:
    e = _files(spark, d).where(F.col("file_id") % STEP == 0).select("file_id", F.concat(F.lit("edited "), F.col("file_id").cast("string")).alias("content"))
    return e.unionAll(spark.createDataFrame([(-1, "new")], "file_id long, content string"))


@query(_w(_F, _EDITS) + "select coalesce(f.file_id, ed.file_id) as file_id, strlen(case when ed.file_id is not null then ed.content else f.content end) as bytes, ed.file_id is not null as edited from f full outer join ed on f.file_id = ed.file_id")
def file_source(spark, d):
    """The text of each file: unsaved edits come before what is stored."""
    return manifest.overlay(_files(spark, d), _edits(spark, d), "file_id", "content").select("file_id", F.octet_length("content").cast("long").alias("bytes"), "edited")


@query(_w(_F, _EDITS, f"o as (select ed.file_id, ed.content from ed union all select file_id, content from f where file_id not in (select file_id from ed))") + f"select word, count(distinct file_id) as files from (select file_id, unnest(regexp_extract_all(content, '{_IDENT}')) as word from o) group by all")
def overlay_merge(spark, d):
    """Postings with the overlay folded in."""
    merged = manifest.overlay(_files(spark, d), _edits(spark, d), "file_id", "content")
    return corpus.word_hash_sets(merged).select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("files"))


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def overlay_latest_event(spark, d):
    """The last event of each path in a feed."""
    return manifest.latest_events(table(spark, d, "events"), "user_id", [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


@query("with n as (select distinct sha256(content) as h, ext, 7 as v from source_files) select h as content_hash, ext as ext_lang, v as parser_version from n anti join (select distinct lower(content_hash) as h, ext_lang as ext, parser_version as v from file_units) using (h, ext, v)")
def content_store_put_get(spark, d):
    """What a put of all contents has to write: units that are not stored for their ending and version."""
    new = table(spark, d, "source_files").select(F.sha2("content", 256).alias("content_hash"), F.col("ext").alias("ext_lang"), F.lit(7).alias("parser_version"))
    stored = table(spark, d, "file_units").select(F.lower("content_hash").alias("content_hash"), "ext_lang", "parser_version")
    return manifest.store_put(stored, new, ["content_hash", "ext_lang", "parser_version"])


@query("select worktree_key, max(generation) as generation, max(generation) + 1 as next_generation, count(*) as row_count from manifest group by all")
def meta_kv(spark, d):
    """Generation and rows of each worktree's manifest, and the generation of its next scan."""
    return table(spark, d, "manifest").groupBy("worktree_key").agg(F.max("generation").alias("generation"), (F.max("generation") + 1).alias("next_generation"), F.count(F.lit(1)).alias("row_count"))


@query(
    """with seen as (select worktree_key, floor(epoch(max(loaded_at)))::bigint as last_seen from manifest group by all)
select w.repo_id, count(*) as worktrees, max(coalesce(seen.last_seen, w.last_seen)) as last_seen from worktrees w left join seen using (worktree_key) group by all"""
)
def registry_upsert(spark, d):
    """Worktrees of each repository, after those with rows in the manifest were seen again when these were loaded."""
    w = table(spark, d, "worktrees").withColumn("generation", F.lit(0)).withColumn("content_hash", F.col("working_dir"))
    seen = table(spark, d, "manifest").groupBy("worktree_key").agg(F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.max("loaded_at")).alias("_seen"))
    again = w.join(seen, "worktree_key").withColumn("last_seen", F.col("_seen")).drop("_seen")
    return manifest.upsert(w, again.select(w.columns), ["worktree_key"]).groupBy("repo_id").agg(F.count(F.lit(1)).alias("worktrees"), F.max("last_seen").alias("last_seen"))


@query(f"select a.repo_id, a.worktree_key as asked, b.worktree_key, b.working_dir, row_number() over (partition by a.repo_id, a.worktree_key order by b.last_seen desc, b.worktree_key) as rank from worktrees a join worktrees b using (repo_id)")
def worktrees_for_repo(spark, d):
    """All worktrees of the repository of each worktree, those seen last first."""
    w = table(spark, d, "worktrees")
    both = w.select("repo_id", F.col("worktree_key").alias("asked")).join(w.select("repo_id", "worktree_key", "working_dir", "last_seen"), "repo_id")
    order = Window.partitionBy("repo_id", "asked").orderBy(F.col("last_seen").desc(), "worktree_key")
    return both.withColumn("rank", F.row_number().over(order).cast("long")).drop("last_seen")


#: Working directories as they are found: root commits, remotes, the folder all worktrees share, and the path.
_FOUND = [("a", ["c2", "c1"], ["git@Host.Example:Org/A.git"], "/a/.git", "/a"), ("b", [], ["https://host.example/org/a/", "https://x.example/b"], "/b/.git", "/b"), ("c", [], [], "/c/.git", "/c/sub"), ("d", [], [], None, "/d")]


@query(
    """select k as worktree_key, sha256(p) as repo_id, s as source from (values ('a', 'c1' || chr(0) || 'c2' || chr(0) || 'https://host.example/org/a', 'commits'),
 ('b', 'https://host.example/org/a' || chr(0) || 'https://x.example/b', 'remotes'), ('c', '/c/.git', 'path'), ('d', '/d', 'path')) as t (k, p, s)"""
)
def identity_ladder(spark, d):
    """Identity of a repository: by its root commits and remotes, else its remotes, else its path."""
    found = spark.createDataFrame(_FOUND, "worktree_key string, roots array<string>, remotes array<string>, shared string, working_dir string")
    remotes = F.array_sort(F.array_distinct(F.transform("remotes", text.normalize_remote)))
    parts = F.concat(F.array_sort("roots"), remotes)
    key = F.when(F.size(parts) > 0, F.array_join(parts, "\0")).otherwise(F.coalesce("shared", "working_dir"))
    source = F.when(F.size("roots") > 0, "commits").when(F.size("remotes") > 0, "remotes").otherwise("path")
    return found.select("worktree_key", F.sha2(key, 256).alias("repo_id"), source.alias("source"))


# ---------------------------------------------------------------- statistics


@query(_w(_F, _S, _G) + "select (select count(*) from f) as files, (select count(*) from g) as definitions, (select count(distinct name) from g) as unique_symbols, (select count(*) from manifest) as manifest_rows")
def corpus_stats(spark, d):
    """Sizes of the corpus and its indexes."""
    g = corpus.global_symbols(_symbols(spark, d)).groupBy("name").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("definitions"), F.count(F.lit(1)).alias("unique_symbols"))
    one = lambda name, col: table(spark, d, name).agg(col).scalar()
    return g.withColumn("files", one("source_files", F.count_distinct("file_id"))).withColumn("manifest_rows", one("manifest", F.count(F.lit(1))))


@query(_w(_S, _G) + "select distinct name from g order by name limit 100")
def sample_symbol_names(spark, d):
    """The first hundred names, as a sample that is the same each time."""
    return corpus.global_symbols(_symbols(spark, d)).select("name").distinct().orderBy("name").limit(100)


@query(_w(_S, _F) + "select (select sum(strlen(name))::bigint from s) as name_bytes, (select sum(strlen(doc_comment))::bigint from s) as doc_bytes, (select sum(strlen(signature))::bigint from s) as signature_bytes, (select sum(strlen(rel_path))::bigint from f) as path_bytes")
def component_bytes(spark, d):
    """Bytes by part of the index."""
    size = lambda c: F.sum(F.octet_length(c)).cast("long")
    s = _symbols(spark, d).agg(size("name").alias("name_bytes"), size("doc_comment").alias("doc_bytes"), size("signature").alias("signature_bytes"))
    paths = table(spark, d, "source_files").groupBy("file_id").agg(F.max("rel_path").alias("p")).agg(size("p")).scalar()
    return s.withColumn("path_bytes", paths)


@query(
    """with v as (select event_type, list_sort(list(value)) as a from events where value is not null group by all)
select event_type, len(a) as n, a[(len(a) // 2) + 1] as median, a[floor(len(a) * 0.99)::int + 1] as p99, a[len(a)] as max, len(list_filter(a, lambda x: x < 50)) / len(a) as below from v"""
)
def latency_stats(spark, d):
    """Median, 99th percentile, maximum and share below a bound, per kind of event.

    The order statistics are those at positions n/2 and 0.99 n of the sorted values: found from counts per value, which
    are combined before the shuffle.
    """
    c = table(spark, d, "events").where("value is not null").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("event_type")
    r = c.withColumn("upto", F.sum("k").over(w.orderBy("value"))).withColumn("n", F.sum("k").over(w))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("value")))
    return r.groupBy("event_type").agg(
        F.first("n").alias("n"), at(F.lit(0.5)).alias("median"), at(F.lit(0.99)).alias("p99"), F.max("value").alias("max"), (F.sum(F.when(F.col("value") < 50, F.col("k")).otherwise(0)) / F.first("n")).alias("below")
    )


# ---------------------------------------------------------------- source code; what a lexer finds has no SQL


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_symbols(parse.distinct_contents(table(spark, d, "source_files")))


@query()
def parse_code(spark, d):
    """Symbols of every distinct content of the corpus."""
    return _parsed(spark, d).drop("doc_comment", "signature")


@query()
def parse_agreement(spark, d):
    """How many of the functions, methods and types of the symbols table the parser finds in the current text, at the same
    line and with the same kind, by language; kinds that the table does not know are left out."""
    s = _symbols(spark, d).where(F.col("name").isNotNull() & F.col("kind").isin("Function", "Method", "Class", "Struct", "TypeAlias"))
    files = table(spark, d, "source_files")
    found = parse.parse_symbols(spread(files).withColumn("_at", F.col("mtime_ns")).withColumn("_hash", F.col("content_hash")).alias("r").join(corpus.newest(files).alias("n"), corpus.same_delivery("r", "n"), "left_semi"))
    lang = _files(spark, d).select("file_id", corpus.family(F.col("ext")).alias("lang"))
    hit = found.select("file_id", "line", "name", F.col("kind").alias("_kind")).dropDuplicates(["file_id", "line", "name"])
    both = s.select("file_id", "line", "name", "kind").join(hit, ["file_id", "line", "name"], "left").join(lang, "file_id").where("lang is not null")
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("symbols"), F.count("_kind").alias("found"), F.sum((F.col("kind") == F.col("_kind")).cast("int")).alias("same_kind"))


@query()
def code_counters(spark, d):
    """Bytes of comments and texts, and identifiers written in ASCII or not, by ending, of all distinct contents."""
    return parse.counters(parse.distinct_contents(table(spark, d, "source_files")))


@query()
def doc_comments(spark, d):
    """Documentation of the symbols at the top level."""
    return _parsed(spark, d).where("doc_comment is not null").select("file_id", "symbol_idx", "name", "doc_comment")


@query()
def signatures(spark, d):
    """Signatures of functions and methods, and their parameters."""
    s = _parsed(spark, d).where(F.col("kind").isin("Function", "Method"))
    return s.select("file_id", "symbol_idx", "name", "signature", text.parameters(F.col("signature")).alias("parameters"))


@query()
def code_occurrences(spark, d):
    """Identifiers of code by role, comments and texts apart."""
    o = parse.parse_occurrences(parse.distinct_contents(table(spark, d, "source_files")))
    return o.groupBy("word", "word_hash").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("role") == "Definition", 1).otherwise(0)).alias("definitions"))


@query(_w(_F, _S, _L, "own as (select * from s)", *_AROUND[1:]) + "select here, symbol_idx as cur, k, name, qualifier, context from cur")
def ident_context(spark, d):
    """What the word at each cursor is, in all files: a field, a call, a type or plain."""
    return _around(spark, d, 1).select("here", F.col("query_id.symbol_idx").alias("cur"), "query_id.k", "name", "qualifier", "context")


@query()
def signature_help(spark, d):
    """The callee, the active parameter and the best definition, for every column of the asked files' lines from which on
    another call or parameter is active; dependencies answer where the workspace does not."""
    files = _files(spark, d).where(F.col("file_id") % STEP == 0)
    calls = parse.call_sites(corpus.lines(files, "file_id"))
    g = corpus.global_symbols(_symbols(spark, d)).where(F.col("signature").isNotNull()).select("file_id", "symbol_idx", "name", "line", "col", "container", "signature")
    deps = _dependencies(spark, d).select("file_id").distinct()
    opened = _openers(spark, d)
    # the answer does not depend on the asking file: the best of each (callee, qualifier) is found once
    asked = calls.select(F.lit(None).cast("long").alias("here"), F.col("callee").alias("name"), "qualifier").distinct()
    key = F.coalesce("qualifier", F.lit("")).alias("_k")
    best = None
    for priority, index in enumerate((g.join(deps, "file_id", "left_anti"), g.join(deps, "file_id", "left_semi"))):
        found = resolve.best_by_name(asked, index, opened).select("name", key, F.struct(F.lit(priority).alias("priority"), F.col("file_id").alias("def_file"), "symbol_idx").alias("r"))
        best = found if best is None else best.unionAll(found)
    best = best.groupBy("name", "_k").agg(F.min("r").alias("r")).select("name", "_k", "r.def_file", "r.symbol_idx")
    best = best.join(g.select(F.col("file_id").alias("def_file"), "symbol_idx", "signature"), ["def_file", "symbol_idx"])
    return calls.withColumn("_k", key).withColumn("name", F.col("callee")).join(best, ["name", "_k"]).select("file_id", "line", "col", "callee", "qualifier", "active", "def_file", "symbol_idx", text.parameters(F.col("signature")).alias("parameters"))


@query(_w(_S, _G) + "select g.file_id, symbol_idx, concat_ws(chr(10) || chr(10), case when signature is not null then '```' || chr(10) || signature || chr(10) || '```' end, case when coalesce(depth, 0) = 0 then doc_comment else 'Type: `' || doc_comment || '`' end) as markdown from g")
def hover_markdown(spark, d):
    """What a hover shows of each definition."""
    return corpus.global_symbols(_symbols(spark, d)).select("file_id", "symbol_idx", _markdown())


def _markdown() -> Column:
    """The signature as code, then the documentation; of what stands in a scope, its type, which is kept in its place."""
    code = F.when(F.col("signature").isNotNull(), F.concat(F.lit("```\n"), "signature", F.lit("\n```")))
    doc = F.when(F.coalesce("depth", F.lit(0)) == 0, F.col("doc_comment")).otherwise(F.concat(F.lit("Type: `"), "doc_comment", F.lit("`")))
    return F.concat_ws("\n\n", code, doc).alias("markdown")


@query(_w(_F, _S, _G, _DEPS) + "select name, file_id, symbol_idx, 'dep' as origin from g where file_id in (select file_id from dep) and name not in (select name from g where file_id not in (select file_id from dep))")
def dep_index(spark, d):
    """Definitions that only dependencies give: these answer where the workspace does not."""
    deps = _dependencies(spark, d).select("file_id").distinct()
    g = corpus.global_symbols(_symbols(spark, d)).join(_files(spark, d).select("file_id"), "file_id", "left_semi")
    own = g.join(deps, "file_id", "left_anti").select("name").distinct()
    return g.join(deps, "file_id", "left_semi").join(own, "name", "left_anti").select("name", "file_id", "symbol_idx", F.lit("dep").alias("origin"))


_ECO = schema.sql_case(dependencies.ECOSYSTEM_OF, f"regexp_extract(rel_path, '{dependencies._DIR}', 1)")
_PACKAGES = f"pk as (select file_id, worktree_key, {_ECO} as ecosystem, regexp_extract(rel_path, '{dependencies._DIR}', 2) as package from f where regexp_matches(rel_path, '{dependencies._DIR}'))"


@query(_w(_F, _S, _G, _PACKAGES) + "select (select count(*) from (select distinct ecosystem, package from pk)) as packages, (select count(*) from pk) as files, (select count(*) from g where file_id in (select file_id from pk)) as definitions")
def dep_counts(spark, d):
    """Packages, files and definitions of the dependency index."""
    return dependencies.counts(_files(spark, d).select("file_id", "worktree_key", "rel_path"), corpus.global_symbols(_symbols(spark, d)).select("file_id"))


@query(_w(_F, _PACKAGES) + "select worktree_key, ecosystem, package, count(*) as files from pk group by all")
def dep_packages(spark, d):
    """The packages whose code lies in each worktree."""
    return dependencies.detect(_files(spark, d).select("file_id", "worktree_key", "rel_path"))


@query(_w(_F, _PACKAGES, f"done as (select distinct ecosystem, package from pk where file_id % {STEP} = 0)") + "select ecosystem, package from (select distinct ecosystem, package from pk) anti join done using (ecosystem, package)")
def dep_pending(spark, d):
    """Packages still to be indexed, after those of each twentieth file were."""
    p = _dependencies(spark, d)
    return dependencies.pending(p.select("ecosystem", "package"), p.where(F.col("file_id") % STEP == 0), ["ecosystem", "package"])


#: A lock file as its tool writes it.
LOCK = """version = 3

[[package]]
name = "memchr"
version = "2.7.1"
source = "registry+https://registry.example/index"
checksum = "523d"

[[package]]
name = "aho-corasick"
version = "1.1.2"
dependencies = [
 "memchr",
]

[[package]]
version = "0.1.0"
name = "own"

[metadata]
name = "no package"
"""


@query("select * from (values ('memchr', '2.7.1', 'registry/memchr-2.7.1'), ('aho-corasick', '1.1.2', 'registry/aho-corasick')) as t (name, version, path)")
def lockfile_packages(spark, d):
    """Packages of a lock file, and the directories in which a registry keeps them; one has none."""
    locked = dependencies.lock_packages(spark.createDataFrame([("w", LOCK)], "worktree_key string, t string"), "worktree_key", "t")
    places = spark.createDataFrame([("registry/memchr-2.7.1",), ("registry/memchr-2.6.0",), ("registry/aho-corasick",), ("registry/other-0.1.0",)], "path string")
    return dependencies.resolve(locked, places).select("name", "version", "path")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
