"""Quality rules by distribution divergence, in DataFrame functions alone.

Each document has two histograms: character classes, and the common words of its
language with all other words as one more entry. A language's reference is the sum of the histograms of all its documents
that pass the base rules. A document is rejected if the Jensen-Shannon distance (base 2,
0 to 1) from a reference is over its limit; a histogram with too few counts proves
nothing, so length guards switch its test off. Documents of a language without a
reference are held to the base rules alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.session import cut

#: Limits of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Length guards and distance limits.
MIN_CHARS, MAX_CHAR_DISTANCE = 200, 0.32
MIN_HISTOGRAM_WORDS, MAX_WORD_DISTANCE = 50, 0.3
#: A language has a reference if at least so many of its documents pass the base rules.
MIN_REFERENCE = 20

# Frequent function words, by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "it", "that", "for", "on", "with", "as", "was", "at", "by", "be", "this", "from", "or", "are", "an"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au", "sur", "avec"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo", "como"],
}

_SPLIT = "[\\x20\\x09-\\x0D]+"
CHAR_CLASSES = ("space", "symbol", "upper", "digit", "mark", "wide", "plain")


def _pick(by_lang: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for lang, value in by_lang.items():
        out = F.when(F.col("lang") == lang, value) if out is None else out.when(F.col("lang") == lang, value)
    return out.otherwise(otherwise)


def _lit_array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def measures(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, lang, the base counts and both histograms of every document, and with whole
    its row as the struct document.

    Null texts count as empty. Counts are taken in the row, so nothing is shuffled. The
    character histogram counts code points, each in one class; its sum is the text's length."""
    text = F.coalesce(F.col("text"), F.lit(""))
    document = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")] * whole
    kept = ["document"] * whole
    base = docs.select("doc_id", "lang", text.alias("text"), *document)
    words = F.filter(F.split("text", _SPLIT), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    d = base.withColumns({"words": words, "lines": lines})
    n = F.size("words")
    window = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at("words", i + k) for k in range(WINDOW)]))
    d = d.withColumn("windows", F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    # only texts with an equal pair of windows are searched for the places of such windows
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("pairs", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), pairs))
    again = F.filter("pairs", lambda p, i: ((i > 0) & (p["h"] == F.get("pairs", F.greatest(i - 1, F.lit(0)))["h"])) | (p["h"] == F.get("pairs", i + 1)["h"]))
    d = d.withColumn("again", F.sort_array(F.transform(again, lambda p: p["i"])))
    covered = F.transform("again", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("again", i + 1) - p, F.lit(WINDOW))))
    repeated = F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    rest = lambda keep: F.length(F.regexp_replace("text", f"[^{keep}]+", "")).cast("bigint")
    word_chars = F.length(F.array_join("words", "")).cast("bigint")
    d = d.select(
        *kept,
        "doc_id",
        "lang",
        n.cast("bigint").alias("n_words"),
        word_chars.alias("word_chars"),
        rest("#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(repeated, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.length("text").cast("bigint").alias("n_text"),
        rest("A-Z").alias("n_upper"),
        rest("0-9").alias("n_digit"),
        rest(".,;:!?'\"()\\-").alias("n_mark"),
        F.length(F.regexp_replace("text", "[\\x00-\\x7F]+", "")).cast("bigint").alias("n_wide"),
        F.when(F.col("lang").isin(list(COMMON_WORDS)), F.transform("words", lambda w: F.lower(w))).alias("low"),
    )
    among = lambda ws: lambda w: w.isin(ws)
    listed = _pick({k: F.filter("low", among(ws)) for k, ws in COMMON_WORDS.items()}, F.array().cast("array<string>"))
    d = d.withColumn("low", F.sort_array(listed)).withColumn("kinds", F.array_distinct("low"))
    d = d.withColumn("begin", F.transform("kinds", lambda w: F.array_position("low", w)))
    number = F.transform("begin", lambda p, i: F.coalesce(F.get("begin", i + 1), F.size("low") + 1) - p)
    d = d.withColumn("number", number)
    count = lambda w: F.coalesce(F.get("number", F.array_position("kinds", w).cast("int") - 1), F.lit(0)).cast("int")
    other = F.array((F.col("n_words") - F.size("low")).cast("int"))
    tally = _pick({k: F.concat(F.transform(_lit_array(ws), count), other) for k, ws in COMMON_WORDS.items()}, F.array().cast("array<int>"))
    plain = F.col("word_chars") - F.col("n_symbols") - F.col("n_upper") - F.col("n_digit") - F.col("n_mark") - F.col("n_wide")
    chars = F.array(F.col("n_text") - F.col("word_chars"), F.col("n_symbols"), F.col("n_upper"), F.col("n_digit"), F.col("n_mark"), F.col("n_wide"), plain)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d.select(*kept, "doc_id", "lang", "n_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), chars.alias("chars"), tally.alias("tally"))


def _plogp(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))


def _distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of equal length; null if one is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    share = lambda a: F.transform(a, lambda x: x.cast("double") / F.nullif(total(a), F.lit(0.0)))
    both = F.zip_with(share(counts), share(reference), lambda p, q: _plogp(p, (p + q) / 2) + _plogp(q, (p + q) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / 2))


def references(measured: DataFrame) -> list[dict]:
    """Histograms of each language of COMMON_WORDS that has enough documents: at most one
    row per listed language. Sums are taken before the shuffle."""
    good = measured.where(~F.col("base_failed") & F.col("lang").isin(list(COMMON_WORDS)))
    places = 1 + max(map(len, COMMON_WORDS.values()))
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(len(CHAR_CLASSES))]
    sums += [F.sum(F.get("tally", F.lit(i))).alias(f"w{i}") for i in range(places)]
    rows = good.groupBy("lang").agg(F.count("*").alias("n"), *sums).collect()
    whole = lambda r, p, n: [int(r[f"{p}{i}"] or 0) for i in range(n)]
    return [{"lang": r["lang"], "chars": whole(r, "c", len(CHAR_CLASSES)), "words": whole(r, "w", 1 + len(COMMON_WORDS[r["lang"]]))} for r in rows if r["n"] >= MIN_REFERENCE]


def _judged(measured: DataFrame) -> DataFrame:
    """measured with char_distance, word_distance and kept."""
    found = {r["lang"]: r for r in references(measured)}
    none = F.lit(None).cast("double")
    longs = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    char, word = none, none
    if found:
        char = _pick({k: _distance(F.col("chars"), longs(r["chars"])) for k, r in found.items()}, none)
        word = _pick({k: _distance(F.col("tally"), longs(r["words"])) for k, r in found.items()}, none)
    out = measured.withColumns({"char_distance": F.when(F.col("n_text") >= MIN_CHARS, F.round(char, 6)), "word_distance": F.when(F.col("n_words") >= MIN_HISTOGRAM_WORDS, F.round(word, 6))})
    far = (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return out.withColumn("kept", ~F.col("base_failed") & ~far)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, char_distance, word_distance, kept.

    A null text is empty, and fails. A null or unlisted language has no reference: the
    distances are null and the base rules decide. Repeated rows are judged alike; extra
    columns are ignored; an empty table gives no rows. Base rules: at least MIN_WORDS
    words, and at most MAX_REPEAT_PERCENT per cent of them in repeated 5-word windows."""
    out = _judged(cut(measures(docs)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, each row judged by itself, whatever its doc_id; rows wait
    beside their counts for the references, so nothing is shuffled."""
    return _judged(cut(measures(docs, whole=True))).where("kept").select("document.*")


def oracle_sql() -> str:
    """The same rules in DuckDB's dialect."""
    word = "[^\\x20\\x09-\\x0D]+"
    lists = " ".join(f"when '{k}' then [{', '.join(repr(w) for w in ws)}]" for k, ws in COMMON_WORDS.items())
    places = 1 + max(map(len, COMMON_WORDS.values()))
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i + 1}])" for i in range(n)) + "]"
    plogp = lambda p, q: f"case when {p} > 0 then {p} * log2({p} / (({p} + {q}) / 2)) else 0.0 end"
    terms = lambda a, b: f"list_transform(range(1, len({a}) + 1), lambda i: {plogp(f'({a}[i] / list_sum({a})::double)', f'({b}[i] / list_sum({b})::double)')} + {plogp(f'({b}[i] / list_sum({b})::double)', f'({a}[i] / list_sum({a})::double)')})"
    jsd = lambda a, b: f"round(sqrt(greatest(0.0, list_sum({terms(a, b)}) / 2)), 6)"
    kept_chars = lambda cs: f"length(regexp_replace(t, '[^{cs}]+', '', 'g'))"
    return f"""
with d as (
  select row_number() over () rid, doc_id, lang, coalesce(text, '') t,
         regexp_extract_all(coalesce(text, ''), '{word}') w,
         case lang {lists} end common,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '{word}')) ls
  from documents),
win as (select rid, i, list_aggregate(w[i:i + {WINDOW - 1}], 'string_agg', ' ') g from (select rid, w, unnest(range(1, len(w) - {WINDOW - 2})) i from d where len(w) >= {WINDOW})),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, g) n from win) where n > 1),
cov as (select rid, count(distinct i + k) n from rep, range({WINDOW}) r(k) group by rid),
m as (
  select d.rid, doc_id, lang, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
         {kept_chars("#*$%&|<>")}::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines,
         coalesce(cov.n, 0)::bigint n_repeat_words, length(t) n_text, {kept_chars("A-Z")} n_upper,
         {kept_chars("0-9")} n_digit, {kept_chars(".,;:!?''\"()\\-")} n_mark, length(regexp_replace(t, '[\\x00-\\x7F]+', '', 'g')) n_wide,
         list_transform(common, lambda c: len(list_filter(w, lambda x: lower(x) = c))) counts
  from d left join cov on d.rid = cov.rid),
h as (
  select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words base_failed,
         [n_text - word_chars, n_symbols, n_upper, n_digit, n_mark, n_wide, word_chars - n_symbols - n_upper - n_digit - n_mark - n_wide] chars,
         list_append(counts, n_words - list_sum(counts)) tally
  from m),
r as (
  select lang, {sums("chars", len(CHAR_CLASSES))} rc, {sums("tally", places)} rw
  from h where not base_failed and counts is not null group by lang having count(*) >= {MIN_REFERENCE}),
j as (
  select h.*, case when rc is not null and n_text >= {MIN_CHARS} then {jsd("chars", "rc")} end char_distance,
         case when rw is not null and n_words >= {MIN_HISTOGRAM_WORDS} then {jsd("tally", "rw")} end word_distance
  from h left join r on h.lang = r.lang)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance,
       not base_failed and coalesce(char_distance, 0) <= {MAX_CHAR_DISTANCE} and coalesce(word_distance, 0) <= {MAX_WORD_DISTANCE} kept
from j"""
