"""Registered queries over documents: filters, hashes, normal forms, masking, deduplication, splits, tokens. Beside each, its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions import hashing, pii, text, tokens
from strataloom.operators import bpe, corpus, filters, near_dup, ordering, splitting
from strataloom.sources import files, shared, sinks

QUERIES: dict = {}
ORACLES: dict = {}

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
HSPACE = r"[ \t\x{a0}\x{2000}-\x{200b}\x{202f}\x{205f}\x{3000}]"
INDENT = r"[ \t\x{a0}\x{2000}\x{200b}\x{202f}\x{205f}\x{3000}-]"
STRIPPED = f"regexp_replace(text, '\\A{WS}+|{WS}+\\z', '', 'g')"
SQUEEZED = f"trim(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g'))"
PRETOKENS = "regexp_extract_all(text, '''s|''t|''re|''ve|''m|''ll|''d| ?[A-Za-z]+| ?[0-9]+| ?[^\\\\sA-Za-z0-9]+')"
BUCKET = "(" + " + ".join(f"CAST(concat('0x', substr(md5(text), {1 + 8 * i}, 8)) AS BIGINT) * {pow(2, 96 - 32 * i, 1000)}" for i in range(4)) + ") % 1000"


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir) and the SQL that states its result."""

    def put(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return put


def documents(spark, sf_dir):
    return files.read_table(spark, f"{sf_dir}/documents.parquet", "doc_id")


def scratch(spark, name: str) -> str:
    """A new folder that driver and executors share."""
    return shared.new(spark, name)


# --- filters, windows and budgets


@query(f"SELECT doc_id, CAST(length({STRIPPED}) AS BIGINT) AS stripped_chars FROM documents WHERE length({STRIPPED}) >= 200 AND (lang IS NULL OR lang = 'en')")
def length_lang_filter(spark, sf_dir):
    return filters.stream_filter(documents(spark, sf_dir)).select("doc_id", F.length(text.strip(F.col("text"))).cast("long").alias("stripped_chars"))


@query("SELECT doc_id, lang, CASE WHEN s IS NULL OR s = 0 THEN 1.0 ELSE s END AS score FROM (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id % 5 - 1) / 4.0 END::DOUBLE AS s FROM documents) WHERE CASE WHEN s IS NULL OR s = 0 THEN 1.0 ELSE s END >= 0.5")
def language_score_filter(spark, sf_dir):
    score = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise((F.col("doc_id") % 5 - 1) / 4.0)
    docs = documents(spark, sf_dir).withColumn("s", score).where(filters.sure_of_language(F.col("s")))
    return docs.select("doc_id", "lang", F.coalesce(F.nullif("s", F.lit(0.0)), F.lit(1.0)).alias("score"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 120 OFFSET 40")
def window_slice(spark, sf_dir):
    """A window of the stream is the feature here."""
    return ordering.offset_window(documents(spark, sf_dir).select("doc_id", "n_chars"), "doc_id", 40, 120)


@query("SELECT doc_id, length(text)::BIGINT AS chars FROM (SELECT doc_id, text, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM documents) WHERE spent < 400000")
def char_budget(spark, sf_dir):
    sized = documents(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("chars"))
    return ordering.within_budget(sized, F.col("chars"), "doc_id", ordering.char_budget(100_000))


@query(f"SELECT doc_id, n AS tokens FROM (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM (SELECT doc_id, len({PRETOKENS}) AS n FROM documents)) WHERE spent < 100000")
def token_budget(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.size(tokens.pretokens(F.col("text"))).cast("long").alias("tokens"))
    return ordering.within_budget(docs, F.col("tokens"), "doc_id", 100_000)


@query("SELECT doc_id, (sum(n_chars) OVER (ORDER BY doc_id))::BIGINT AS running_chars, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS place FROM documents")
def running_totals(spark, sf_dir):
    docs = ordering.running_sum(documents(spark, sf_dir).select("doc_id", "n_chars"), F.col("n_chars"), "doc_id", "running_chars", inclusive=True)
    return ordering.position(docs, "doc_id", "place").drop("n_chars")


# --- hashes, deduplication, counters


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, strlen(text)::BIGINT AS bytes FROM documents")
def content_hashes(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", hashing.sha256_text(F.col("text")).alias("sha256"), F.md5("text").alias("md5"), F.octet_length("text").cast("long").alias("bytes"))


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {STRIPPED}")
def exact_dedup(spark, sf_dir):
    return filters.exact_dedup(documents(spark, sf_dir), text=text.strip(F.col("text"))).select("doc_id")


@query("""SELECT count(DISTINCT text) FILTER (length(text) >= 200)::BIGINT AS docs_kept, (count(*) FILTER (length(text) >= 200) - count(DISTINCT text) FILTER (length(text) >= 200))::BIGINT AS duplicates_removed,
  count(*) FILTER (length(text) < 200)::BIGINT AS too_short_removed, (SELECT sum(length(t)) FROM (SELECT DISTINCT text AS t FROM documents WHERE length(text) >= 200))::BIGINT AS total_chars FROM documents""")
def dedup_counters(spark, sf_dir):
    return filters.dedup_counters(documents(spark, sf_dir), 200)


NORMAL = f"""regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), chr(10)), lambda l:
  concat(regexp_extract(l, '\\A({INDENT}*)', 1), regexp_replace(regexp_replace(substr(l, length(regexp_extract(l, '\\A({INDENT}*)', 1)) + 1), '{HSPACE}+', ' ', 'g'), '{WS}+\\z', ''))), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\A\\n+|\\n+\\z', '', 'g')"""
MESSY = "concat('  - x', chr(9), chr(9), 'y  ', chr(10), chr(10), chr(10), chr(10), replace(text, ' ', '  '), chr(1), chr(10), chr(10))"


@query(f"SELECT doc_id, sha256({NORMAL}) AS sha256, length({NORMAL})::BIGINT AS chars FROM (SELECT doc_id, {MESSY} AS t FROM documents)")
def normalize_native(spark, sf_dir):
    """Documents with indentation, doubled spaces, controls and blank lines put in."""
    messy = F.concat(F.lit("  - x\t\ty  \n\n\n\n"), F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\x01\n\n"))
    normal = documents(spark, sf_dir).select("doc_id", text.normalize(messy, None).alias("t"))
    return normal.select("doc_id", F.sha2("t", 256).alias("sha256"), F.length("t").cast("long").alias("chars"))


# What NFKC makes of the characters put in: ligature, full-width, superscript, circled, Roman, a letter and its accent, unit signs, no-break space.
COMPOSED = {"\ufb01": "fi", "\uff21": "A", "\u00b2": "2", "\u2460": "1", "\u2163": "IV", "e\u0301": "\u00e9", "\u212b": "\u00c5", "\u33a2": "km2", "\u00a0": " "}
_BEFORE, _AFTER = (" ".join(f"x{c}y" for c in side) for side in (COMPOSED, COMPOSED.values()))


@query(f"SELECT doc_id, sha256({NORMAL}) AS sha256, length({NORMAL})::BIGINT AS chars FROM (SELECT doc_id, concat('{_AFTER} ', text, chr(10), '{_AFTER}') AS t FROM documents)")
def normalize_nfkc(spark, sf_dir):
    """Documents with characters put in that NFKC changes; the SQL has what they become."""
    t = F.concat(F.lit(f"{_BEFORE} "), F.col("text"), F.lit(f"\n{_BEFORE}"))
    normal = documents(spark, sf_dir).select("doc_id", text.normalize(t).alias("t"))
    return normal.select("doc_id", F.sha2("t", 256).alias("sha256"), F.length("t").cast("long").alias("chars"))


@query(f"SELECT doc_id, length(text)::BIGINT AS chars, strlen(text)::BIGINT AS bytes, len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> ''))::BIGINT AS words, sha256({SQUEEZED}) AS squeezed FROM documents")
def text_stats(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", F.length(t).cast("long").alias("chars"), F.octet_length(t).cast("long").alias("bytes"), text.word_count(t).cast("long").alias("words"), F.sha2(text.squeeze(t), 256).alias("squeezed"))


CODE = "CASE WHEN contains(text, 'def ') OR contains(text, 'import ') OR (contains(text, '(') AND contains(text, ')')) THEN 'code' ELSE 'prose' END"


@query(f"SELECT {CODE} AS kind, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def prose_code_split(spark, sf_dir):
    kind = F.when(text.looks_like_code(F.col("text")), "code").otherwise("prose")
    return documents(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"))


# --- near-duplicates


def _native_near_dup_sql() -> str:
    mins = ", ".join(f"min((v * {a} + {c}) % {near_dup.PRIME}) AS m{i}" for i, (a, c) in enumerate(near_dup.linear_coefficients(16)))
    rows = ", ".join(f"m{i}" for i in range(16))
    same = " + ".join(f"(l.m{i} = r.m{i})::INT" for i in range(16))
    bands = " UNION ALL ".join(f"SELECT doc_id, {b} AS band, concat_ws('_', m{4 * b}, m{4 * b + 1}, m{4 * b + 2}, m{4 * b + 3}) AS key FROM sig" for b in range(4))
    return f"""
WITH x AS (SELECT doc_id, hex(encode(lower({SQUEEZED}))) AS x FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN strlen(x) <= 10 THEN x ELSE substr(x, CAST(2 * i + 1 AS INTEGER), 10) END AS s FROM (SELECT doc_id, x, unnest(range(greatest(1, strlen(x) // 2 - 4))) AS i FROM x)),
sig AS (SELECT doc_id, {mins} FROM (SELECT doc_id, CAST(concat('0x', substr(md5(s), 1, 8)) AS BIGINT) AS v FROM sh) GROUP BY doc_id),
banded AS ({bands}),
pairs AS (SELECT DISTINCT l.doc_id AS a, r.doc_id AS b FROM banded l JOIN banded r ON l.band = r.band AND l.key = r.key AND l.doc_id < r.doc_id),
removed AS (SELECT DISTINCT b FROM pairs JOIN sig l ON l.doc_id = a JOIN sig r ON r.doc_id = b WHERE ({same}) >= 0.8 * 16)
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT b FROM removed)"""


@query(_native_near_dup_sql())
def near_dedup_native(spark, sf_dir):
    return near_dup.near_dedup(documents(spark, sf_dir).select("doc_id", "text"), 0.8, 16, 4, native=True).select("doc_id")


@query()
def near_dedup(spark, sf_dir):
    """BLAKE2 sketches of 64 places in 8 bands; SQL has no such hash."""
    return near_dup.near_dedup(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id")


# --- masking

_SQL_PII = {k: v.replace(r"(?<!\d)", "").replace(r"(?!\d)", "").replace("'", "''") for k, v in pii.PATTERNS.items()}


def _masked_sql(text_sql: str = "text") -> str:
    """Masked step by step. RE2 has no look-around; greedy runs end where the guards hold, except after a digit and '+'."""
    steps, at = [f"m0 AS (SELECT doc_id, {text_sql} AS t FROM documents)"], "m0"
    done: list[str] = []
    for i, (n, p) in enumerate(_SQL_PII.items(), 1):
        kept = "".join(f"hits_{d}, " for d in done)
        steps.append(f"m{i} AS (SELECT doc_id, {kept}len(regexp_extract_all(t, '{p}')) AS hits_{n}, regexp_replace(t, '{p}', '<|{n}|>', 'g') AS t FROM {at})")
        done.append(n)
        at = f"m{i}"
    return "WITH " + ",\n".join(steps)


_HITS = ", ".join(f"hits_{n}::BIGINT AS hits_{n}" for n in pii.PATTERNS)


@query(f"{_masked_sql()} SELECT doc_id, {_HITS}, sha256(t) AS sha256 FROM m8")
def pii_scrub(spark, sf_dir):
    scrubbed = pii.scrub(documents(spark, sf_dir).select("doc_id", "text"))
    return scrubbed.select("doc_id", *[F.col(f"hits_{n}").cast("long").alias(f"hits_{n}") for n in pii.PATTERNS], F.sha2("text", 256).alias("sha256"))


#: Made-up findings of the classes that the tables don't hold, in words that both engines read alike.
_PLANTED = """concat(text, chr(10), 'at 10.', CAST(doc_id % 10 AS STRING), '.2.3 by AKIA', repeat('Q7', 8), CASE doc_id % 4 WHEN 0 THEN concat(' and gho_', repeat('a1', 18 + CAST(doc_id % 3 AS INTEGER)), '.')
  WHEN 1 THEN concat(chr(10), '-----BEGIN RSA ', 'PRIVATE KEY-----', chr(10), 'abc+/=', chr(10), '-----END RSA ', 'PRIVATE KEY-----') WHEN 2 THEN concat(' PassWord = ''no', CAST(doc_id AS STRING), '; Tokens: short12345 ') ELSE ' pwd ghp_short AKIAshort 1.2.3' END)"""


@query(f"{_masked_sql(_PLANTED)} SELECT doc_id, {_HITS}, sha256(t) AS sha256 FROM m8")
def pii_planted(spark, sf_dir):
    """Masking of texts to which addresses, keys, tokens and passwords were added."""
    scrubbed = pii.scrub(documents(spark, sf_dir).select("doc_id", F.expr(_PLANTED).alias("text")))
    return scrubbed.select("doc_id", *[F.col(f"hits_{n}").cast("long").alias(f"hits_{n}") for n in pii.PATTERNS], F.sha2("text", 256).alias("sha256"))


@query(f"{_masked_sql()}, sums AS ({' UNION ALL '.join(f'''SELECT '{n}' AS class, sum(hits_{n})::BIGINT AS hits FROM m8''' for n in pii.PATTERNS)}) SELECT class, hits FROM sums WHERE hits > 0")
def pii_totals(spark, sf_dir):
    return pii.totals(pii.scrub(documents(spark, sf_dir).select("doc_id", "text")))


# --- splits


@query(f"SELECT doc_id, ({BUCKET})::INTEGER AS bucket, CASE WHEN {BUCKET} < 50 THEN 'val' ELSE 'train' END AS split FROM documents")
def hash_split(spark, sf_dir):
    return splitting.hash_split(documents(spark, sf_dir)).select("doc_id", hashing.md5_bucket(F.col("text")).alias("bucket"), "split")


@query(f"SELECT CASE WHEN {BUCKET} < 50 THEN 'val' ELSE 'train' END AS split, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def hash_split_stats(spark, sf_dir):
    return splitting.hash_split(documents(spark, sf_dir)).groupBy("split").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) > count(*) OVER () - greatest(1, CAST(floor(count(*) OVER () * 0.05) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM documents")
def prefix_split(spark, sf_dir):
    return splitting.prefix_split(documents(spark, sf_dir).select("doc_id"), "doc_id", 0.05)


FLAGSHIP_SQL = f"""
WITH kept AS (SELECT doc_id, lang, {STRIPPED} AS t FROM documents WHERE length({STRIPPED}) >= 200),
firsts AS (SELECT t AS text, min(doc_id) AS doc_id FROM kept GROUP BY t),
split AS (SELECT d.lang, f.text, CASE WHEN {BUCKET.replace('text', 'f.text')} < 50 THEN 'val' ELSE 'train' END AS split FROM firsts f JOIN documents d USING (doc_id))
SELECT split, lang, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM split GROUP BY split, lang"""


@query(FLAGSHIP_SQL)
def flagship(spark, sf_dir):
    """Long enough, first of equal texts, split by hash: counts by split and language."""
    docs = filters.stream_filter(documents(spark, sf_dir), lang=None).select("doc_id", "lang", text.strip(F.col("text")).alias("text"))
    docs = splitting.hash_split(filters.exact_dedup(docs))
    return docs.groupBy("split", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"))


# --- tokens


@query(f"SELECT p AS pretoken, count(*) AS n FROM (SELECT unnest({PRETOKENS}) AS p FROM documents) GROUP BY p")
def pretoken_counts(spark, sf_dir):
    return tokens.pretoken_counts(documents(spark, sf_dir))


@query(f"SELECT p AS pretoken, count(*) AS n FROM (SELECT unnest({PRETOKENS}) AS p FROM documents) GROUP BY p HAVING count(*) >= 5")
def frequent_pretokens(spark, sf_dir):
    return tokens.pretoken_counts(documents(spark, sf_dir), 5)


_PAIRS = f"""WITH c AS (SELECT hex(encode(p)) AS x, count(*) AS n FROM (SELECT unnest({PRETOKENS}) AS p FROM documents) GROUP BY p),
b AS (SELECT substr(x, CAST(2 * i + 1 AS INTEGER), 2) AS "left", substr(x, CAST(2 * i + 3 AS INTEGER), 2) AS "right", n FROM (SELECT x, n, unnest(range(strlen(x) // 2 - 1)) AS i FROM c WHERE strlen(x) >= 4)),
s AS (SELECT "left", "right", sum(n)::BIGINT AS n FROM b GROUP BY 1, 2)"""


@query(f"{_PAIRS} SELECT * FROM s")
def byte_pair_counts(spark, sf_dir):
    return tokens.byte_pair_counts(tokens.pretoken_counts(documents(spark, sf_dir)))


@query(f'{_PAIRS} SELECT * FROM s ORDER BY n DESC, "left" DESC, "right" DESC LIMIT 1')
def best_pair(spark, sf_dir):
    return tokens.best_pair(tokens.byte_pair_counts(tokens.pretoken_counts(documents(spark, sf_dir))))


@query(f"""WITH t AS (SELECT {CODE} AS kind, text, {PRETOKENS} AS p, len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '')) AS w FROM documents),
s AS (SELECT coalesce(kind, 'overall') AS split, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars, sum(strlen(text))::BIGINT AS n_bytes, sum(strlen(array_to_string(p, '')))::BIGINT AS n_tokens, sum(w) AS n_words, sum((array_to_string(p, '') = text)::INT) AS ok FROM t GROUP BY GROUPING SETS ((kind), ()))
SELECT split, n_docs, n_chars, n_bytes, n_tokens, round(n_tokens / n_bytes, 9) AS tokens_per_byte, round(n_chars / n_tokens, 9) AS chars_per_token, round(n_tokens / n_words, 9) AS fertility, round(ok / n_docs, 9) AS round_trip_rate FROM s""")
def tokenizer_eval_bytes(spark, sf_dir):
    """Quality of a vocabulary of bytes: every byte of a pre-token is a token."""
    docs = documents(spark, sf_dir)
    joined = F.array_join(tokens.pretokens(F.col("text")), "")
    x = F.hex(F.encode(joined, "UTF-8"))
    one_each = F.split(F.regexp_replace(x, "(..)(?!\\z)", "$1,"), ",")
    kind = F.when(text.looks_like_code(F.col("text")), "code").otherwise("prose")
    report = bpe.quality_report(docs, F.when(x == "", F.array()).otherwise(one_each), joined, kind)
    return report.select(*[F.round(c, 9).alias(c) if k == "double" else c for c, k in report.dtypes])


VOCABULARY = 1024


@query()
def bpe_train(spark, sf_dir):
    """rank, left, right (hex) of the merges learnt from all documents."""
    return bpe.train(documents(spark, sf_dir), VOCABULARY).tables(spark)[1].select("rank", F.hex("left").alias("left"), F.hex("right").alias("right"))


@query()
def tokenizer_eval(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = bpe.train(docs, VOCABULARY)
    return bpe.evaluation(docs, model, F.when(text.looks_like_code(F.col("text")), "code").otherwise("prose"))


# Without a backslash, pieces give back the text whatever the vocabulary, so what comes out is known.
@query("SELECT doc_id, NOT contains(text, chr(92)) AS round_trip FROM documents")
def bpe_roundtrip(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = bpe.train(docs, 512)
    return docs.select("doc_id", (bpe.decoder(model)(bpe.encoder(model)(F.col("text"))) == F.col("text")).alias("round_trip"))


# --- files


@query(f"SELECT sha256({STRIPPED}) AS sha256, count(*) AS n FROM documents WHERE {STRIPPED} <> '' GROUP BY 1")
def corpus_file_roundtrip(spark, sf_dir):
    """Documents written as corpus text with end marks, and read again."""
    folder = scratch(spark, "corpus")
    sinks.write_corpus(documents(spark, sf_dir), folder, "doc_id", bpe.END_OF_TEXT)
    back = files.read_corpus(spark, folder, f"\n{bpe.END_OF_TEXT}\n")
    return back.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT sha256({STRIPPED}) AS sha256, count(*) AS n FROM documents WHERE {STRIPPED} <> '' GROUP BY 1")
def file_scan(spark, sf_dir):
    """Documents written as text files with blank lines between, found by suffix, cut and stripped."""
    folder = scratch(spark, "files")
    sinks.write_corpus(documents(spark, sf_dir), folder, "doc_id")
    docs = files.file_documents(files.collect_files(spark, folder, 1_000_000, 1 << 30)).select(text.strip(F.col("text")).alias("text"))
    return docs.where("text <> ''").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, sha256(d) AS sha256 FROM (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, '. '), lambda x: regexp_replace(x, '\\A{WS}+|{WS}+\\z', '', 'g')), lambda x: x <> '')) AS d FROM documents)")
def split_on_mark(spark, sf_dir):
    """Texts cut at a mark, parts stripped, empty ones left out."""
    docs = documents(spark, sf_dir).select("doc_id", F.explode(files.split_documents(F.col("text"), ". ")).alias("d"))
    return docs.select("doc_id", F.sha2("d", 256).alias("sha256"))


_PRINT = """h AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) AS p, sha256(text) AS h FROM documents), c AS (SELECT p // 10000 AS c, sha256(string_agg(h, '' ORDER BY p)) AS h FROM h GROUP BY 1),
f AS (SELECT sha256(string_agg(h, '' ORDER BY c)) AS corpus_sha256 FROM c)"""


@query(f"""WITH {_PRINT}, d AS (SELECT text, length(text) AS n, count(*) AS c FROM documents GROUP BY text),
s AS (SELECT count(*) FILTER (n >= 20) AS kept, coalesce(sum(c - 1) FILTER (n >= 20), 0)::BIGINT AS again, coalesce(sum(c) FILTER (n < 20), 0)::BIGINT AS short, coalesce(sum(n) FILTER (n >= 20), 0)::BIGINT AS chars FROM d)
SELECT concat('{{"corpus_sha256":"', corpus_sha256, '","docs_kept":', kept, ',"duplicates_removed":', again, ',"filters":"exact_dedup_sha256","name":"corpus","too_short_removed":', short, ',"total_chars":', chars, ',"version":"1"}}') AS manifest FROM f, s""")
def corpus_manifest(spark, sf_dir):
    """One row of JSON: counters, and the fingerprint of the corpus in order."""
    docs = documents(spark, sf_dir)
    values = filters.dedup_counters(docs).crossJoin(sinks.fingerprint(docs, "doc_id"))
    return sinks.manifest(values, name="corpus", version="1", filters="exact_dedup_sha256")


@query(f"WITH {_PRINT} SELECT corpus_sha256 FROM f")
def corpus_fingerprint(spark, sf_dir):
    return sinks.fingerprint(documents(spark, sf_dir), "doc_id")


# --- the corpus build


def chunks(spark, sf_dir):
    """Documents whose texts differ in spaces, controls and line ends, so that some are equal in normal form only."""
    t = F.concat(F.repeat(F.lit("\n"), (F.col("doc_id") % 3).cast("int")), F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(" "), F.lit("  "))).otherwise(F.col("text")), F.when(F.col("doc_id") % 5 == 0, F.lit("\x01 \t")).otherwise(""))
    return documents(spark, sf_dir).select("doc_id", t.alias("text"), (F.col("doc_id") % 7).alias("file"))


_CHUNKS = "SELECT doc_id, concat(repeat(chr(10), CAST(doc_id % 3 AS INTEGER)), CASE WHEN doc_id % 2 = 0 THEN replace(text, ' ', '  ') ELSE text END, CASE WHEN doc_id % 5 = 0 THEN concat(chr(1), ' ', chr(9)) ELSE '' END) AS t FROM documents"
_BUILT = f"n AS (SELECT doc_id, {NORMAL} AS text FROM ({_CHUNKS})), built AS (SELECT min(doc_id) AS doc_id, text FROM n WHERE length(text) >= 20 GROUP BY text)"


@query(f"WITH {_BUILT} SELECT doc_id, sha256(text) AS sha256, length(text)::BIGINT AS chars FROM built")
def corpus_build(spark, sf_dir):
    """Normal form, minimum length, first of equal normal forms."""
    built = corpus.build_corpus(chunks(spark, sf_dir), "doc_id")
    return built.select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("chars"))


@query(f"""WITH {_BUILT} SELECT (SELECT count(*) FROM built) AS docs_kept, count(*) FILTER (length(text) >= 20) - (SELECT count(*) FROM built) AS duplicates_removed,
  count(*) FILTER (length(text) < 20) AS too_short_removed, (SELECT sum(length(text)) FROM built)::BIGINT AS total_chars, count(DISTINCT doc_id % 7) AS files_read FROM n""")
def corpus_build_counters(spark, sf_dir):
    return corpus.build_counters(chunks(spark, sf_dir), file_col="file")


@query("SELECT doc_id, length(text)::BIGINT AS chars FROM (SELECT doc_id, text, sum(length(text) + 2) OVER (ORDER BY doc_id) - 2 AS ends FROM documents) WHERE ends <= 300000")
def head_sample(spark, sf_dir):
    """Whole documents from the head of the corpus: the limit is the feature here."""
    return corpus.head_sample(documents(spark, sf_dir), "doc_id", 300_000).select("doc_id", F.length("text").cast("long").alias("chars"))


# --- merges of a small vocabulary, which a recursive query learns too

SMALL = 288
_LEARNT = f"""words AS (SELECT hex(encode(p)) AS h, count(*) AS n FROM (SELECT unnest({PRETOKENS}) AS p FROM documents) GROUP BY p),
w(step, h, x, n, l, r) AS (
  SELECT 0, h, regexp_replace(h, '(..)', '<\\1>', 'g'), n, NULL::VARCHAR, NULL::VARCHAR FROM words
  UNION ALL
  SELECT step + 1, h, replace(x, concat('<', b.l, '><', b.r, '>'), concat('<', b.l, b.r, '>')), n, b.l, b.r
  FROM w, (SELECT split_part(p, '><', 1) AS l, split_part(p, '><', 2) AS r FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: concat(t[i], '><', t[i + 1]))) AS p, n FROM (SELECT string_split(x[2:-2], '><') AS t, n FROM w)) GROUP BY p ORDER BY sum(n) DESC, l DESC, r DESC LIMIT 1) b
  WHERE step < {SMALL - 257})"""
_CODED = f"""{_LEARNT},
ids AS (SELECT printf('%02X', i) AS token, i AS id FROM range(256) t(i) UNION ALL SELECT DISTINCT concat(l, r), 256 + step FROM w WHERE step > 0),
coded AS (SELECT h, list(id ORDER BY p) AS ids FROM (SELECT h, unnest(string_split(x[2:-2], '><')) AS token, generate_subscripts(string_split(x[2:-2], '><'), 1) AS p FROM w WHERE step = {SMALL - 257}) JOIN ids USING (token) GROUP BY h),
places AS (SELECT doc_id, generate_subscripts(t, 1) AS p, hex(encode(unnest(t))) AS h FROM (SELECT doc_id, {PRETOKENS} AS t FROM documents)),
texts AS (SELECT doc_id, flatten(list(ids ORDER BY p)) AS ids FROM places JOIN coded USING (h) GROUP BY doc_id)"""


@query(f'WITH RECURSIVE {_LEARNT} SELECT DISTINCT step - 1 AS rank, l AS "left", r AS "right" FROM w WHERE step > 0')
def bpe_train_small(spark, sf_dir):
    merges = bpe.train(documents(spark, sf_dir), SMALL).tables(spark)[1]
    return merges.select(F.col("rank"), F.hex("left").alias("left"), F.hex("right").alias("right"))


@query(f"WITH RECURSIVE {_CODED} SELECT doc_id, len(ids) AS n_tokens, md5(array_to_string(ids, ',')) AS ids_md5 FROM texts")
def bpe_encode(spark, sf_dir):
    docs = documents(spark, sf_dir)
    ids = bpe.encoder(bpe.train(docs, SMALL))(F.col("text"))
    return docs.select("doc_id", ids.alias("ids")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(F.concat_ws(",", "ids")).alias("ids_md5"))


_REPORTED = f"""d AS (SELECT CASE WHEN contains(text, 'def ') OR contains(text, 'import ') OR (contains(text, '(') AND contains(text, ')')) THEN 'code' ELSE 'prose' END AS kind, length(text) AS c, strlen(text) AS b,
  coalesce(len(ids), 0) AS t, len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '')) AS w, (NOT contains(text, chr(92)))::INT AS ok FROM documents LEFT JOIN texts USING (doc_id)),
s AS (SELECT coalesce(kind, 'overall') AS split, count(*) AS n_docs, sum(c)::BIGINT AS n_chars, sum(b)::BIGINT AS n_bytes, sum(t)::BIGINT AS n_tokens, sum(w) AS n_words, sum(ok) AS ok FROM d GROUP BY GROUPING SETS ((kind), ()))"""


@query(f"WITH RECURSIVE {_CODED}, {_REPORTED} SELECT split, n_docs, n_chars, n_bytes, n_tokens, round(n_tokens / n_bytes, 9) AS tokens_per_byte, round(n_chars / n_tokens, 9) AS chars_per_token, round(n_tokens / n_words, 9) AS fertility, round(ok / n_docs, 9) AS round_trip_rate FROM s")
def tokenizer_eval_small(spark, sf_dir):
    docs = documents(spark, sf_dir)
    report = bpe.evaluation(docs, bpe.train(docs, SMALL), F.when(text.looks_like_code(F.col("text")), "code").otherwise("prose"))
    return report.select(*[F.round(c, 9).alias(c) if k == "double" else c for c, k in report.dtypes])


_PACK_TOKENS = f"""{_CODED}, e AS (SELECT doc_id, CASE WHEN {BUCKET} < 50 THEN 'val' ELSE 'train' END AS split, list_append(coalesce(ids, []), 256) AS toks FROM documents LEFT JOIN texts USING (doc_id)),
u AS (SELECT split, doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS p FROM e),
o AS (SELECT split, tok, row_number() OVER (PARTITION BY split ORDER BY doc_id, p) - 1 AS pos, count(*) OVER (PARTITION BY split) AS n FROM u),
l AS (SELECT split, pos // 64 AS block, pos, tok, lead(tok) OVER (PARTITION BY split ORDER BY pos) AS label, n FROM o)"""


@query(f"WITH RECURSIVE {_PACK_TOKENS} SELECT split, block, md5(string_agg(tok::VARCHAR, ',' ORDER BY pos)) AS input_ids, md5(string_agg(label::VARCHAR, ',' ORDER BY pos)) AS labels FROM l WHERE block < (n - 1) // 64 GROUP BY split, block")
def pack_tokenized(spark, sf_dir):
    """Texts to ids of a vocabulary learnt from them, with an end mark, to blocks by split."""
    docs = documents(spark, sf_dir)
    blocks = corpus.pack_corpus(docs.select("doc_id", "text"), bpe.train(docs, SMALL), 64, "doc_id")
    return blocks.select("split", "block", F.md5(F.concat_ws(",", "input_ids")).alias("input_ids"), F.md5(F.concat_ws(",", "labels")).alias("labels"))
