"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Fixed kinds (email, ip, card, phone) are found by pattern and checked. Each value found is a
protected entity. A term (word of three letters or more) seen within WINDOW characters of an entity
in two different contexts discloses it when what the term tells about the entity, the pointwise
mutual information, reaches SHARE of the entity's own information content. All its counts are of
whole documents of the corpus: those with the entity, with the term, and with both. One context
proves nothing: a word of one passage, or of its copies, always tells everything about a value there.
(The window chooses candidates because all words times all entities of a document would grow with
the square of its length.) A disclosing term is marked wherever it stands in a document that holds
the entity, outside the spans. It is generalised to the class of words that begin alike (three letters, or one), if the
class has a word so frequent that it cannot reach SHARE whatever it stands beside, and removed otherwise.

Possessive patterns keep Java's matcher from recursing on long runs; ``\\G`` admits a match that
starts where the last one ended inside a run, as a plain left-to-right scan would find it.

Defined cases: null text is empty (no span); repeated rows get the same spans; a null doc_id is kept;
an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinemill.llm.common import doc_text, stage, table

KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?+[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: A text without these has no match of the kind, which spares the pattern.
NEEDS = (r"@", None, None, r"+")
BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"\p{L}{3,}+"
WINDOW, SHARE = 100, 0.9
#: Elements of an array that are summed up in one growing array.
BLOCK = 128
#: Code points of the strings that a text is cut into where parts of it are read by position.
CHUNK = 256
#: Letters by which words of a class begin alike, the finest class first.
PREFIXES = (3, 1)


def located(text: Column, pattern: str, needs: str | None = None) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points."""
    none = F.lit(None).cast("array<string>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if needs:
        matches = F.when(F.contains(text, F.lit(needs)), matches).otherwise(none)
    return matches


def _with_running(df: DataFrame, values: str, out: str) -> DataFrame:
    """df with out: before each of the column's integers, the sum of those before it.

    Sums run within blocks, then over the blocks, so that growing arrays stay short. (A lambda sees a
    column as often as it has elements: columns that lambdas read are made in a projection of their
    own and named twice, which keeps the optimizer from moving their expressions into the lambda.)
    """
    n = F.size(values)
    one = F.array(F.lit(0))
    block = lambda b: F.aggregate(F.sequence(b * BLOCK + 1, F.least((b + 1) * BLOCK, n)), one, lambda acc, i: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(values, i))))
    df = df.withColumn("_inner", F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), block)))
    offsets = F.aggregate(F.transform("_inner", lambda x: F.element_at(x, -1)), one, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    sums = F.zip_with("_inner", F.slice(offsets, F.lit(1), F.size("_inner")), lambda x, o: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda y: y + o))
    return df.withColumn(out, F.flatten(sums)).drop("_inner")


def _with_places(df: DataFrame, text: str, matches: str, pattern: str, out: str) -> DataFrame:
    """df with out: array<struct<start, end, value>> of a text's matches of a pattern, from what lies between them."""
    some = F.size(matches) > 0
    gaps = F.transform(F.slice(F.split(F.col(text), pattern, -1), F.lit(1), F.size(matches)), F.length)
    df = df.withColumn("_gaps", F.when(some, gaps))
    df = df.withColumn("_steps", F.zip_with("_gaps", F.transform(matches, F.length), lambda a, b: a + b))
    df = _with_running(df, "_steps", "_before")
    placed = F.zip_with(F.zip_with("_before", "_gaps", lambda a, g: a + g), matches, lambda at, v: F.struct(at.alias("start"), (at + F.length(v)).alias("end"), v.alias("value")))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return df.withColumn(out, F.when(some, placed).otherwise(empty)).drop("_gaps", "_steps", "_before")


def _with_chunks(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with out: the text in an array of strings of CHUNK code points each, the last one shorter."""
    return df.withColumn(out, F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))


def _between(chunks: str, begin: Column, end: Column) -> Column:
    """The code points from begin to end of a text in chunks; only the chunks that it touches are read."""
    first, last = F.floor(begin / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    at = lambda i: F.element_at(chunks, i + 1)
    inner = F.when(last - first > 1, F.array_join(F.transform(F.sequence(first + 1, last - 1), at), "")).otherwise(F.lit(""))
    more = F.concat(F.substring(at(first), begin - first * CHUNK + 1, F.lit(CHUNK)), inner, F.substring(at(last), F.lit(1), end - last * CHUNK))
    return F.when(end <= begin, F.lit("")).when(first == last, F.substring(at(first), begin - first * CHUNK + 1, end - begin)).otherwise(more)


def _with_covered(df: DataFrame, text: str, spans: str, put, out: str) -> DataFrame:
    """df with out: the text with every maximal stretch that the spans cover replaced by put(first span of it, its length).

    Starts and ends in order tell how many spans are open in each piece.
    """
    df = df.withColumn("_points", F.array_sort(F.concat(
        F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("step"), s.alias("s"))), F.transform(spans, lambda s: F.struct(s["end"].alias("at"), F.lit(-1).alias("step"), F.lit(None).cast(_element(df, spans)).alias("s"))))))
    df = _with_running(df.withColumn("_steps", F.transform("_points", lambda p: p["step"])), "_steps", "_open")
    df = _with_chunks(df, text, "_chunks").withColumn("_n", F.length(text))
    m, end = F.greatest(F.size("_open"), F.size("_points")), F.col("_n")

    def piece(k: Column) -> Column:
        """What stands before the k-th point (from 0) and, if it opens a stretch, in the stretch's place."""
        begin = F.when(k == 0, 0).otherwise(F.element_at("_points", k)["at"])
        to = F.when(k == m, end).otherwise(F.element_at("_points", F.least(k + 1, m))["at"])
        plain = _between("_chunks", begin, to)
        free = F.when(k == m, True).otherwise(F.element_at("_open", F.least(k + 1, m)) == 0)
        return F.concat(F.when(free, plain).otherwise(put(None, to - begin)), F.when(free & (k < m), put(F.element_at("_points", F.least(k + 1, m))["s"], None)).otherwise(F.lit("")))

    cut = F.array_join(F.transform(F.sequence(F.lit(0), m), piece), "")
    return df.withColumn(out, F.when(F.size(spans) > 0, cut).otherwise(F.col(text))).drop("_points", "_steps", "_open", "_chunks", "_n")


def _element(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.elementType.simpleString()


def _blank(span: Column | None, length: Column | None) -> Column:
    """Spaces for what spans cover: no word stands there, and other words keep their places."""
    return F.lit("") if length is None else F.repeat(F.lit(" "), length)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _valid(kind: int, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == 1:
        return F.rlike(value, F.lit(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
    if kind == 2:
        return F.when((n >= 12) & (n <= 19), _luhn(digits)).otherwise(False)
    return (n >= 9) & (n <= 15) if kind == 3 else F.lit(True)


def _checked(kind: int):
    return lambda x: _valid(kind, x["value"])


def _tagged(kind: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value"))


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with spans array<struct<start, kind, end, value>> by start, then kind."""
    for k, pattern in enumerate(PATTERNS):
        docs = docs.withColumn(f"_m{k}", located(F.col("text"), pattern, NEEDS[k]))
    for k, pattern in enumerate(PATTERNS):
        docs = _with_places(docs, "text", f"_m{k}", pattern, f"_p{k}")
        docs = docs.withColumn(f"_s{k}", F.transform(F.filter(f"_p{k}", _checked(k)), _tagged(k)))
    spans = F.array_sort(F.concat(*(F.col(f"_s{k}") for k in range(len(PATTERNS)))))
    return docs.select("doc_id", "text", spans.alias("spans"))


def _entity(span: Column) -> Column:
    return F.xxhash64(span["kind"], F.lower(span["value"]))


def _words(text: str) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _class(letters: int):
    """The coarser class of a term; no term ends in the mark."""
    return lambda term: F.concat(F.substring(term, 1, letters), F.lit("*"))


def _near(held: DataFrame) -> DataFrame:
    """(entity, context, term): words about each entity that lie in no span. A word that the window's edge cuts is no word."""
    wide = _with_chunks(_with_chunks(held, "text", "_raw"), "free", "_free").select("spans", "_raw", "_free", F.length("text").alias("_n"))

    def window(c: str, begin: Column, end: Column) -> Column:
        return _between(c, F.greatest(begin, F.lit(0)), F.least(end, F.col("_n")))

    def about(s: Column) -> Column:
        raw = F.xxhash64(window("_raw", s["start"] - WINDOW, s["start"]), window("_raw", s["end"], s["end"] + WINDOW))
        before, after = window("_free", s["start"] - WINDOW - 1, s["start"]), window("_free", s["end"], s["end"] + WINDOW + 1)
        before = F.when(F.length(before) > WINDOW, F.regexp_replace(before, r"^\p{L}++", "")).otherwise(before)
        after = F.when(F.length(after) > WINDOW, F.regexp_replace(after, r"(?<!\p{L})\p{L}++$", "")).otherwise(after)
        terms = F.regexp_extract_all(F.lower(F.concat(before, F.lit(" "), after)), F.lit(TERM), F.lit(0))
        return F.struct(_entity(s).alias("entity"), raw.alias("context"), F.array_distinct(terms).alias("terms"))

    one = wide.select(F.explode(F.transform("spans", about)).alias("a"))
    return one.select("a.entity", "a.context", F.explode("a.terms").alias("term"))


def disclosing(held: DataFrame, docs: DataFrame, share: float = SHARE) -> DataFrame:
    """(row, term, ratio, put): the terms of each row that disclose an entity of it, and what stands in their place.

    held: the rows (row, text, spans) with spans, and free, the text with blanks in their place; docs: the
    whole corpus, whose counts decide.
    """
    seen = _near(held).groupBy("entity", "term").agg(F.min("context").alias("lo"), F.max("context").alias("hi")).where("lo <> hi")
    seen = stage(seen.select("entity", "term"), "near")
    own = held.select("row", F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity"))
    entity = own.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    words = docs.select(F.explode(_words("text")).alias("term"))
    counts = stage(words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")), "counts")
    total = F.lit(docs.count()).cast("double")
    # documents of a term beyond which it cannot reach the share, as it stands beside an entity n_entity times at most
    most = F.pow("n_entity", F.lit(share)) * F.pow(total, F.lit(1 - share))
    pairs = stage(seen.join(entity, "entity").join(counts, "term").where(F.col("n_term") <= most), "pairs")
    there = held.select("row", F.explode(_words("free")).alias("term")).join(pairs.select("entity", "term"), "term").join(own, ["row", "entity"])
    there = stage(there.select("row", "entity", "term"), "there")
    together = there.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("together"))
    tells = F.log2(F.col("together") * total / (F.col("n_entity") * F.col("n_term")))
    content = -F.log2(F.col("n_entity") / total)
    told = pairs.join(together, ["entity", "term"]).withColumn("ratio", F.when(content > 0, tells / content)).where(F.col("ratio") >= share)
    put = []
    for k, n in enumerate(PREFIXES):
        # a class has the documents of its most frequent word at least
        known = counts.groupBy(_class(n)(F.col("term")).alias(f"_c{k}")).agg(F.max("n_term").alias(f"_n{k}"))
        told = told.withColumn(f"_c{k}", _class(n)(F.col("term"))).join(known, f"_c{k}", "left")
        put.append(F.when(F.col(f"_n{k}") > most, F.concat(F.lit("["), F.upper(f"_c{k}"), F.lit("]"))))
    told = told.select("entity", "term", "ratio", F.coalesce(*put, F.lit("")).alias("put"))
    return there.join(told, ["entity", "term"]).groupBy("row", "term").agg(F.max("ratio").alias("ratio"), F.min("put").alias("put"))


def find_personal(df: DataFrame) -> DataFrame:
    """(doc_id, th, base, terms): spans of the fixed kinds and of disclosing terms, per row.

    base: array<struct<start, kind, end>>; terms: array<struct<start, kind, end, ratio, put>>, put
    being the class that a term is generalised to, or nothing. th is the text's xxhash64.
    """
    docs = doc_text(df)
    found = base_spans(docs).select("doc_id", F.xxhash64("text").alias("th"), F.when(F.size("spans") > 0, F.col("text")).alias("text"), "spans", F.monotonically_increasing_id().alias("row"))
    found = stage(found, "personal")
    held = _with_covered(found.where("text is not null").select("row", "text", "spans"), "text", "spans", _blank, "free")
    held = stage(held, "held")
    told = disclosing(held, docs).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("ratio", "put")))).alias("told"))
    told = held.select("row", "free").join(told, "row").withColumn("_m", F.regexp_extract_all("free", F.lit(TERM), F.lit(0)))
    told = _with_places(told, "free", "_m", TERM, "_w")
    marks = F.transform("_w", lambda x: F.struct(x["start"].alias("start"), F.lit(4).alias("kind"), x["end"].alias("end"), F.try_element_at("told", F.lower(x["value"])).alias("t")))
    marks = F.transform(F.filter(marks, lambda x: x["t"].isNotNull()), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["t"]["ratio"].alias("ratio"), x["t"]["put"].alias("put")))
    base = found.select("row", "doc_id", "th", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("base"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,ratio:double,put:string>>")
    return base.join(told.select("row", marks.alias("terms")), "row", "left").select("doc_id", "th", "base", F.coalesce("terms", none).alias("terms"))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def sanitised(df: DataFrame) -> DataFrame:
    """The table with its text column cleaned: a span of the fixed kinds becomes [KIND], a disclosing
    term its class, as [QUE*], or nothing. Other columns stay as they are."""
    spans = find_personal(df)
    marks = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)), F.lit("]")).alias("put"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["put"].alias("put"))),
    )
    marks = spans.where("size(base) > 0 or size(terms) > 0").select(F.col("doc_id").alias("_d"), F.col("th").alias("_h"), marks.alias("_marks")).dropDuplicates(["_d", "_h"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(text) == F.col("_h"))
    joined = df.join(marks, on, "left").withColumn("_old", text)
    # of overlapping spans the first one's mark stands for all
    joined = _with_covered(joined, "_old", "_marks", lambda s, n: F.lit("") if s is None else s["put"], "_new")
    return joined.select(*(F.when(F.col("_marks").isNull(), F.col(c)).otherwise(F.col("_new")).alias(c) if c == "text" else F.col(f"`{c}`") for c in df.columns))


def op4_pii(spark, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    every = F.array_sort(F.concat("base", F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))))
    return found.select(
        "doc_id", n(0), n(1), n(2), n(3), F.size("terms").cast("long").alias("n_term"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"),
    )
