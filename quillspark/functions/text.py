"""Text functions as column expressions: everything here runs in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import catalogue as K


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def any_match(c: Column | str, patterns: list[str]) -> Column:
    """Whether one of the patterns is found, as one expression: the text is decoded once."""
    return col(c).rlike("|".join(f"(?:{p})" for p in patterns))


def trimmed(c: Column | str) -> Column:
    """Trim all of ``K.BLANKS``; Spark's own trim knows U+0020 only unless told."""
    return F.trim(col(c), F.lit(K.BLANKS))


def compact(c: Column | str) -> Column:
    """Without any white space."""
    return F.regexp_replace(col(c), r"(?U)\s+", "")


def replace_all(c: Column, words: list[str], by: str) -> Column:
    return reduce(lambda a, w: F.replace(a, F.lit(w), F.lit(by)), words, c)


def let(values: dict[str, Column], f) -> Column:
    """``f`` of a struct of values, each of which is evaluated once however often ``f``
    names it: Spark does not share repeated parts of conditional expressions."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f), 1)


def count_chars(c: Column | str, kind: str) -> Column:
    """How many characters are of a kind, a character class without its brackets."""
    return F.length(col(c)) - F.length(F.regexp_replace(col(c), f"[{kind}]+", ""))


def extract(c: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where nothing matches."""
    found = F.regexp_extract(col(c), pattern, group)
    return F.when(col(c).rlike(pattern), found)


# ---- lines and pages (X1-X7, F10) -----------------------------------------------


def normal_line(c: Column | str) -> Column:
    return trimmed(F.regexp_replace(col(c), "[ \t]+", " "))


def line_signature(c: Column | str) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(normal_line(c)), r"[^\p{L}\p{N}]+", "")


def is_advertisement(c: Column | str) -> Column:
    """Whether a pattern of advertisements is found. All of them have a Han character or
    one of a few words, which are looked for first: most texts have neither."""
    maybe = lambda x: reduce(lambda a, w: a | F.contains(x["low"], F.lit(w)), K.ADVERTISING_WORDS, x["text"].rlike(r"[\x{4e00}-\x{9fff}]"))
    return let({"text": col(c), "low": F.lower(col(c))}, lambda x: maybe(x) & any_match(x["text"], K.ADVERTISEMENT))


def is_noise_line(c: Column | str) -> Column:
    line = normal_line(c)
    return (line == "") | line.rlike(K.PAGE_NUMBER) | is_advertisement(line) | line.rlike(K.DAMAGED)


def meaningful(c: Column | str) -> Column:
    return count_chars(c, r"\p{IsHan}A-Za-z0-9")


def quality_score(c: Column | str) -> Column:
    """Share of meaningful characters, less four times the share of damaged ones, less
    up to 0.7 for letters that stand alone; from 0 to 1."""
    alone = F.regexp_count(col(c), F.lit(r"(?<![\p{L}\p{N}])[A-Za-z](?![\p{L}\p{N}])"))
    damaged = count_chars(c, K.DAMAGED[1:-1])

    def score(x: Column) -> Column:
        penalty = F.when(x["letters"] > 0, F.least(F.lit(0.7), x["alone"] / x["letters"] * 0.8)).otherwise(0.0)
        return F.when(x["size"] == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["letters"] / x["size"] - x["damaged"] / x["size"] * 4 - penalty)))

    return let({"size": F.length(compact(c)), "letters": meaningful(c), "alone": alone, "damaged": damaged}, score)


def lines_of(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(c), r"\r?\n"), normal_line), lambda x: x != "")


def is_reliable(c: Column | str) -> Column:
    """Whether a page's text layer can be used without recognition."""
    useful = F.array_join(F.filter(lines_of(c), lambda x: ~is_advertisement(x)), "")
    return (meaningful(c) >= 48) & (quality_score(c) >= 0.62) & (F.length(useful) >= 40)


def numeral(c: Column) -> Column:
    """A number of 0 to 99 in Chinese or Arabic numerals; null otherwise."""
    digits = F.create_map(*[x for i, d in enumerate("零一二三四五六七八九") for x in (F.lit(d), F.lit(i))])
    tens = r"^([一二三四五六七八九]?)十([一二三四五六七八九]?)$"
    left, right = F.regexp_extract(c, tens, 1), F.regexp_extract(c, tens, 2)
    value = F.when(left == "", 1).otherwise(F.element_at(digits, left)) * 10 + F.when(right == "", 0).otherwise(F.element_at(digits, right))
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("int")).when(c.rlike(tens), value).otherwise(F.element_at(digits, c))


def chapter_label(number: Column) -> Column:
    return F.when(number.isNotNull(), F.concat(F.lit("第"), F.coalesce(numeral(number).cast("string"), number), F.lit("章")))


def chapter_heading(c: Column | str) -> Column:
    return chapter_label(extract(normal_line(c), K.CHAPTER_HEADING))


def section_heading(c: Column | str) -> Column:
    line = normal_line(c)
    return F.when(line.rlike(K.SECTION_NUMBER), trimmed(F.concat_ws(" ", F.regexp_extract(line, K.SECTION_NUMBER, 1), F.regexp_extract(line, K.SECTION_NUMBER, 2))))


def requested_chapter(c: Column | str) -> Column:
    return chapter_label(extract(c, K.CHAPTER))


def looks_like_toc(c: Column | str) -> Column:
    count = lambda lines, test: F.size(F.filter(lines, test))

    def judged(x: Column) -> Column:
        n = F.size(x["lines"])
        leaders = count(x["lines"], lambda y: y.rlike(K.LEADER))
        outline = count(x["lines"], lambda y: y.rlike(K.OUTLINE))
        prose = count(x["lines"], lambda y: (F.length(y) >= 36) & y.rlike(K.PROSE_END))
        return F.when(n < 4, False).otherwise((leaders >= 2) | ((outline / n >= 0.45) & (prose / n < 0.2)))

    return let({"lines": lines_of(c)}, judged)


# ---- questions (R1, R8, R9, R18, X22) --------------------------------------------


def normalized(c: Column | str) -> Column:
    """Lower case, short subject names spelt out, without punctuation and blanks."""
    out = F.lower(col(c))
    for short, full in K.ALIASES.items():
        out = F.replace(out, F.lit(short), F.lit(full))
    return F.regexp_replace(out, K.PUNCTUATION, "")


def query_terms(c: Column | str) -> Column:
    """Distinct terms in order: words of a-z, 0-9 and _, runs of Han characters, and
    after a run of four or more its pairs of neighbours."""
    clean = replace_all(F.replace(F.lower(col(c)), F.lit("计组"), F.lit(K.ALIASES["计组"])), K.INTENT_WORDS, " ")
    runs = F.regexp_extract_all(clean, F.lit(r"[a-z0-9_]+|[\x{4e00}-\x{9fff}]+"), F.lit(0))

    def spread(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(r"^[\x{4e00}-\x{9fff}]{4,}$"), F.concat(F.array(run), pairs)).otherwise(F.array(run))

    return F.array_distinct(F.flatten(F.transform(runs, spread)))


def core_terms(c: Column | str) -> Column:
    clean = replace_all(normalized(c), K.QUERY_NOISE, "")
    return F.filter(query_terms(clean), lambda t: t.rlike("(?i)^[a-z0-9_]{2,}$") | t.rlike(r"^\p{IsHan}{2,}$"))


def without_deixis(c: Column | str) -> Column:
    return F.regexp_replace(col(c), K.DEIXIS, "")


def term_coverage(query: Column | str, *fields: Column | str) -> Column:
    """Share of the question's core terms that occur in the fields; 1 without terms."""
    terms = core_terms(without_deixis(trimmed(query)))
    where = normalized(F.concat_ws(" ", *map(text, fields)))
    return F.when(F.size(terms) == 0, 1.0).otherwise(F.size(F.filter(terms, lambda t: F.contains(where, normalized(t)))) / F.size(terms))


def outcome_coverage(query: Column | str, *fields: Column | str) -> Column:
    """Coverage by at most 16 terms after a longer list of noise; 0 without terms."""
    terms = F.slice(F.filter(query_terms(replace_all(F.lower(col(query)), K.OUTCOME_NOISE, " ")), lambda t: F.length(t) >= 2), 1, 16)
    where = signature_text(F.concat_ws(" ", *map(text, fields)))
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.filter(terms, lambda t: F.contains(where, signature_text(t)))) / F.size(terms))


def signature_text(c: Column | str) -> Column:
    """Letters and digits, lower case: what two passages are compared by."""
    return F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}]+", "")


def occurrences(hay: Column, needle: Column) -> Column:
    """How often ``needle`` occurs without overlaps."""
    return F.when(F.length(needle) == 0, 0).otherwise((F.length(hay) - F.length(F.replace(hay, needle, F.lit("")))) / F.length(needle)).cast("int")


def lexical_score(query: Column | str, content: Column | str, title: Column | str, tags: Column | str) -> Column:
    """0.62 x coverage + 0.28 x frequency + 0.2 for the whole phrase, at most 1."""
    terms = query_terms(query)
    body, head, labels = (F.lower(text(c)) for c in (content, title, tags))
    counts = F.transform(terms, lambda t: occurrences(body, t) + 4 * occurrences(head, t) + 3 * occurrences(labels, t))
    n = F.size(terms)
    coverage = F.size(F.filter(counts, lambda x: x > 0)) / n
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    frequency = F.least(F.lit(1.0), total / F.greatest(F.lit(2), n * 2))
    phrase = F.when(F.contains(F.concat(head, F.lit(" "), body), trimmed(F.lower(col(query)))), 0.2).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), coverage * 0.62 + frequency * 0.28 + phrase))


def estimated_tokens(c: Column | str) -> Column:
    return let({"han": count_chars(text(c), r"\p{IsHan}"), "n": F.length(text(c))}, lambda x: x["han"] + F.ceil((x["n"] - x["han"]) / 4)).cast("long")


def core_title(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(normalized(c), K.TITLE_YEAR, ""), K.TITLE_WORDS, ""), "[0-9]+", "")


def definition_subject(c: Column | str) -> Column:
    """What a question asks the definition of; null where it is not one thing."""
    q = F.regexp_replace(compact(c), K.DEFINITION_PREFIX, "")
    asked = F.coalesce(extract(q, K.DEFINITION_LEADING), extract(q, K.DEFINITION_TRAILING))
    subject = without_deixis(normalized(asked))
    return F.when(~subject.rlike(K.NOT_ONE_SUBJECT) & (F.length(subject) >= 2), subject)


def defines_subject(query: Column | str, content: Column | str) -> Column:
    """Whether a passage holds what the question asks the definition of: the governed
    concept of a relation, an identifier, or any occurrence that reads on as a
    definition. True where the question asks for no definition."""
    return subject_defined(definition_subject(query), normalized(text(content)))


def subject_defined(subject: Column, body: Column) -> Column:
    """``defines_subject`` for a subject and a normalised passage that are columns already."""
    governed = extract(subject, K.RELATIONAL)
    tail = F.when(F.contains(subject, F.lit("的")), F.substring_index(subject, "的", -1))
    latin = F.regexp_extract(subject, "^[a-z0-9_]+", 0)
    rest = F.when((latin != "") & (F.length(latin) < F.length(subject)), F.substring(subject, F.length(latin) + 1, F.length(subject)))
    candidates = F.filter(F.array_distinct(F.array(subject, tail, rest)), lambda x: x.isNotNull() & (F.length(x) >= 2))

    def grounded(x: Column) -> Column:
        # parts between occurrences: all but the first begin where an occurrence ended
        after = F.slice(F.split(body, F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))), 2, 1 << 30)
        return F.contains(body, x) & (x.rlike("(?i)[a-z0-9_]") | F.exists(after, lambda y: y.rlike("^" + K.DEFINES)))

    related = F.coalesce(F.contains(body, governed), F.lit(False))
    return F.when(subject.isNull(), True).otherwise(related | F.exists(candidates, grounded))


def multi_fact_queries(c: Column | str) -> Column:
    """The question and, where it asks for two to five facts at once, one question each."""
    q = compact(c)
    summary = extract(q, K.SUMMARY_OF)
    listed = F.coalesce(summary, F.element_at(F.split(q, K.SEPARATELY), 1))
    parts = F.filter(F.transform(F.split(listed, K.LIST_SEPARATOR), lambda s: trimmed(F.regexp_replace(s, K.SUBJECT_PREFIX, ""))), lambda s: F.length(s) >= 2)
    suffix = F.regexp_extract(F.try_element_at(parts, F.lit(-1)), K.SHARED_SUFFIX, 0)
    asks = F.when(q.rlike(K.HOW_MANY), F.lit("是多少")).otherwise(F.lit("是什么"))
    each = F.transform(parts, lambda s: F.concat(F.when((suffix != "") & ~F.endswith(s, suffix), F.concat(s, suffix)).otherwise(s), asks))
    several = (q.rlike(K.SEPARATELY) | summary.isNotNull()) & F.size(parts).between(2, 5)
    return F.when(several, F.array_distinct(F.concat(F.array(trimmed(c)), each))).otherwise(F.array(trimmed(c)))


# ---- evidence (F11, A16, X11, X14, X15, X18) -------------------------------------


def sentences(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(text(c), r"(?<=[。！？!?])|\n+"), trimmed), lambda s: s != "")


def sanitized(c: Column | str) -> Column:
    """Without sentences that try to instruct a model."""
    return trimmed(F.array_join(F.filter(sentences(c), lambda s: ~any_match(s, K.INJECTION)), "\n"))


def evidence_sentences(query: Column | str, content: Column | str, limit: int = 6) -> Column:
    """Up to ``limit`` sentences by the terms of the question they hold, in text order."""
    found = sentences(sanitized(content))
    terms = F.filter(query_terms(query), lambda t: F.length(t) >= 2)
    score = lambda s: F.aggregate(terms, F.lit(0), lambda a, t: a + F.when(F.contains(compact(F.lower(s)), t), F.least(F.lit(6), F.length(t))).otherwise(0))
    ranked = F.transform(found, lambda s, i: F.struct((-score(s)).alias("r"), i.alias("i"), s.alias("s")))
    good = F.filter(ranked, lambda x: x["r"] < 0)
    pool = F.slice(F.array_sort(F.when(F.size(good) > 0, good).otherwise(F.transform(ranked, lambda x: F.struct(F.lit(0).alias("r"), x["i"].alias("i"), x["s"].alias("s"))))), 1, limit)
    by_place = F.array_sort(F.transform(pool, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
    return F.when(F.size(found) <= limit, found).otherwise(F.transform(by_place, lambda x: x["s"]))


def conflict_values(question: Column | str, evidence: Column | str) -> Column:
    """Values with units of which the evidence names more than one, where the question
    asks for one: in order of the unit's, then the value's first occurrence."""
    units = F.transform(F.regexp_extract_all(text(evidence), F.lit(K.QUANTITY), F.lit(2)), F.lower)
    values = F.regexp_extract_all(text(evidence), F.lit(K.QUANTITY), F.lit(1))
    pairs = F.array_distinct(F.zip_with(units, values, lambda u, v: F.struct(u.alias("u"), v.alias("v"))))
    of = F.transform(F.array_distinct(units), lambda u: F.filter(pairs, lambda p: p["u"] == u))
    found = F.transform(F.flatten(F.filter(of, lambda g: F.size(g) > 1)), lambda p: F.concat(p["v"], p["u"]))
    return F.when(col(question).rlike(K.ASKS_FOR_ONE), found).otherwise(F.array().cast("array<string>"))


def preserves_conflicts(question: Column | str, answer: Column | str, evidence: Column | str) -> Column:
    values, said = conflict_values(question, evidence), F.lower(compact(answer))
    return (F.size(values) == 0) | (col(answer).rlike(K.ADMITS_CONFLICT) & F.forall(values, lambda v: F.contains(said, v)))


def references(c: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(text(c), F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.try_cast("int"))


def citations_valid(answer: Column | str, n: Column | int, overview: Column | bool = False) -> Column:
    """Whether an answer cites, and only evidence there is; every substantial line of an overview must."""
    refs, n = references(answer), F.lit(n) if isinstance(n, int) else n
    lines = F.filter(F.transform(F.split(text(answer), "\n+"), trimmed), lambda x: (F.length(x) >= 8) & ~x.rlike(r"^#{1,6}(?U:\s)") & ~x.rlike("^(?:以下|根据|现有资料)"))
    fine = (n > 0) & (F.size(refs) > 0) & ~F.exists(refs, lambda r: F.coalesce((r < 1) | (r > n), F.lit(True)))
    return fine & (~(F.lit(overview) if isinstance(overview, bool) else overview) | F.forall(lines, lambda x: x.rlike(r"\[[0-9]+\]")))


def renumbered(answer: Column | str, n: Column | int) -> Column:
    """The answer with its citations numbered by first appearance; null if one is not valid."""
    refs = F.array_distinct(references(answer))
    # parts between citations end with "]" already removed: "text [7" -> number after the last "["
    parts = F.split(text(answer), r"(?<=\[[0-9]{1,9})\]")
    swapped = F.transform(
        parts,
        lambda p, i: F.when(
            (i < F.size(parts) - 1),
            F.concat(F.regexp_extract(p, r"(?s)^(.*\[)[0-9]+$", 1), F.array_position(refs, F.regexp_extract(p, r"\[([0-9]+)$", 1).try_cast("int")).cast("string"), F.lit("]")),
        ).otherwise(p),
    )
    return F.when(citations_valid(answer, n), F.array_join(swapped, ""))


def escaped(c: Column | str) -> Column:
    return F.replace(F.replace(F.replace(text(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


# ---- fields (S4, S9, S11, S13, F14, X19, X20) -------------------------------------


def pages_of(c: Column | str) -> Column:
    """Pages between form feeds; one blank page at the end goes, all blank is none."""
    parts = F.split(text(c), "\f")
    blank = trimmed(F.element_at(parts, -1)) == ""
    kept = F.when(blank, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(F.forall(parts, lambda p: trimmed(p) == ""), F.array().cast("array<string>")).otherwise(kept)


def recognised(c: Column | str) -> Column:
    """Recognised text: no blanks between Han characters or before line ends."""
    joined = F.regexp_replace(text(c), r"(?<=\p{IsHan})[ \t]+(?=\p{IsHan})", "")
    return trimmed(F.regexp_replace(joined, r"[ \t]+\n", "\n"))


def repaired_filename(c: Column | str) -> Column:
    """UTF-8 read as Latin-1 is put right, unless a character or the result forbids it."""
    latin = ~col(c).rlike(r"[^\x{00}-\x{FF}]")
    fixed = F.encode(F.when(latin, col(c)).otherwise(F.lit("")), "ISO-8859-1").cast("string")
    valid = F.is_valid_utf8(fixed)
    return F.when(latin & valid & ~F.contains(fixed, F.lit("\ufffd")), fixed).otherwise(col(c))


def display_title(filename: Column | str) -> Column:
    base = F.regexp_replace(F.regexp_replace(col(filename), r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")
    return trimmed(F.regexp_replace(base, K.FILE_SUFFIX, ""))


def masked_contact(c: Column | str) -> Column:
    v = text(c)
    at = F.instr(v, "@")
    mail = F.concat(F.substring(v, F.lit(1), F.least(F.lit(2), at - 1)), F.lit("***"), F.substring(v, at, F.length(v)))
    digits = F.when(F.length(v) <= 4, F.lit("****")).otherwise(F.concat(F.substring(v, 1, 3), F.lit("****"), F.right(v, F.lit(2))))
    return F.when(v == "", "").when(at > 1, mail).when(v.rlike("^[0-9]+$"), digits).otherwise("****")


def parsed_tags(c: Column | str) -> Column:
    parts = F.transform(F.split(F.replace(text(c), F.lit("，"), F.lit(",")), ","), trimmed)
    return F.slice(F.array_distinct(F.filter(parts, lambda x: x != "")), 1, 20)


def tags_from_json(c: Column | str) -> Column:
    """The strings of a JSON array; other elements are dropped, no array gives none."""
    found = F.from_json(F.when(F.schema_of_variant(F.try_parse_json(col(c))).startswith("ARRAY"), col(c)), "array<variant>")
    strings = F.filter(found, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(strings, lambda v: F.variant_get(v, "$", "string")), F.array().cast("array<string>"))


def day_of(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd")


def byte_size(c: Column | str) -> Column:
    """A size in B, KB or MB, with one decimal from KB on."""
    n = col(c)
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024**2, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / 1024**2))


def labelled(c: Column | str, kind: str) -> Column:
    """The display name of a role, share status or visibility."""
    names = K.LABELS[kind]
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), col(c))


# ---- refining an answer (X17) ------------------------------------------------------


def refinement_valid(answer: Column | str, n: Column | int) -> Column:
    """Whether a refined answer cites what the first one cited, or admits there is nothing."""
    refs, n = references(answer), F.lit(n) if isinstance(n, int) else n
    return F.when(n <= 0, ~F.contains(text(answer), F.lit("现有资料没有提供相关信息"))).otherwise((F.size(refs) > 0) & F.forall(refs, lambda r: F.coalesce((r >= 1) & (r <= n), F.lit(False))))


def refined(instruction: Column | str, answer: Column | str) -> Column:
    """A shorter answer without a model: its first sentence if one is asked for, the first
    half of its lines if it should be shorter, else the answer."""
    lines = F.filter(F.transform(F.split(text(answer), "\n+"), trimmed), lambda x: x != "")
    flat = F.regexp_replace(text(answer), r"(?U)\s*\n+\s*", " ")
    one = F.coalesce(F.nullif(F.regexp_extract(flat, r"^.*?[。！？!?](?:(?U:\s)*\[[0-9]+\])*", 0), F.lit("")), F.try_element_at(lines, F.lit(1)), trimmed(answer))
    half = F.array_join(F.slice(lines, F.lit(1), F.greatest(F.lit(1), F.ceil(F.size(lines) / 2)).cast("int")), "\n")
    return F.when(~col(instruction).rlike(K.SHORTEN), trimmed(answer)).when(col(instruction).rlike(K.ONE_SENTENCE), one).otherwise(half)
