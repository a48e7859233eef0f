"""Text expressions: markers, log fields, details, reader clean-up, JSON repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewright.functions.space import is_blank_text, strip
from gradewright.functions.collections import map_keeping_last
from gradewright.functions.numeric import clamp, col_of, round_half_up, safe_double
from gradewright.settings import (
    DEFAULTS,
    SAFETY_PHRASES,
    TRAILING_NOISE,
    TYPE_CODES,
    Thresholds,
)

# ---- page markers -----------------------------------------------------------

MARKER = r"(?s)^P\s*([+-]?\d+)\s*_(.*)$"


def marker_page(qr) -> Column:
    """Page number of a marker like ``P2_COM101``; null when it is not one."""
    return F.regexp_extract(col_of(qr), MARKER, 1).try_cast("int")


def marker_exam(qr) -> Column:
    qr = col_of(qr)
    return F.when(marker_page(qr).isNotNull(), F.regexp_extract(qr, MARKER, 2))


# ---- stage log --------------------------------------------------------------

STAGE_TAG = "[STAGE]"

# field name, type; the message field may hold blanks and runs to the line end
STAGE_FIELDS = (
    ("stage", "string"),
    ("state", "string"),
    ("eid", "string"),
    ("sIdx", "int"),
    ("sTotal", "int"),
    ("sNum", "string"),
    ("qNum", "string"),
    ("qType", "string"),
    ("elapsedMs", "bigint"),
    ("hadAi", "int"),
    ("ocrMs", "bigint"),
    ("aiMs", "bigint"),
)


def stage_head(line) -> Column:
    """The fields of a line without its free-text message."""
    return F.regexp_replace(col_of(line), r"(?s)\bmsg=.*$", "")


def stage_field(head, name: str, kind: str = "string") -> Column:
    """One ``name=value`` field of a line head."""
    text = F.nullif(F.regexp_extract(col_of(head), rf"(?:^|\s){name}=(\S*)", 1), F.lit(""))
    return text if kind == "string" else text.try_cast(kind)


def stage_message(line) -> Column:
    return F.nullif(F.regexp_extract(col_of(line), r"(?s)\bmsg=(.*)$", 1), F.lit(""))


def stage_map(line) -> Column:
    """All fields of a stage line as a map; extra fields are kept."""
    line = col_of(line)
    body = F.regexp_replace(line, r"^.*?\[STAGE\]\s*", "")
    head = stage_head(body)
    keys = F.regexp_extract_all(head, F.lit(r"(?:^|\s)([A-Za-z_]\w*)=(\S*)"), F.lit(1))
    values = F.regexp_extract_all(head, F.lit(r"(?:^|\s)([A-Za-z_]\w*)=(\S*)"), F.lit(2))
    msg = stage_message(body)
    with_msg = F.when(msg.isNotNull(), F.array(msg)).otherwise(F.array().cast("array<string>"))
    msg_key = F.when(msg.isNotNull(), F.array(F.lit("msg"))).otherwise(F.array().cast("array<string>"))
    return map_keeping_last(F.concat(keys, msg_key), F.concat(values, with_msg))


# ---- detail strings of a score sheet ----------------------------------------

# fixed values: the forms in which score sheets and replies are written
CELL_MATCHED = r"#(\d+):\s*'([^']*)'\s*=\s*'([^']*)'\s*\[(OK|X)\]"
CELL_ANY = r"#(\d+):\s*'([^']*)'\s*!?=\s*'([^']*)'\s*\[(OK|X)\]"
CHOICE_MATCHED = r"\b(?:chose|Correct \(|\(see )([A-D])"
CHOICE_ANY = r"\b(?:chose |Correct \(|\(see )([A-D])"


def detail_cells(detail, keep_wrong: bool = False) -> Column:
    """Cells of a detail string as {item: read text}.

    The plain pattern finds accepted cells only; ``keep_wrong`` also reads the
    cells written with ``!=``.
    """
    d, pattern = F.coalesce(col_of(detail), F.lit("")), F.lit(CELL_ANY if keep_wrong else CELL_MATCHED)
    return map_keeping_last(
        F.regexp_extract_all(d, pattern, F.lit(1)), F.regexp_extract_all(d, pattern, F.lit(2))
    )


def detail_choice(detail, tolerant: bool = False) -> Column:
    """Letter of a single-choice detail; the plain pattern misses ``chose X``."""
    pattern = CHOICE_ANY if tolerant else CHOICE_MATCHED
    return F.nullif(F.regexp_extract(F.coalesce(col_of(detail), F.lit("")), pattern, 1), F.lit(""))


# ---- reader clean-up --------------------------------------------------------


def strip_trailing_noise(text) -> Column:
    return F.rtrim(col_of(text), F.lit(TRAILING_NOISE))


def digits_only(text) -> Column:
    return F.regexp_replace(col_of(text), r"[^0-9]", "")


def first_letter(text, allowed: Column | None = None) -> Column:
    """First letter, upper-cased; with ``allowed`` the first one of that set."""
    letters = F.regexp_replace(F.upper(F.coalesce(col_of(text), F.lit(""))), r"\P{L}", "")
    if allowed is None:
        return F.substring(letters, 1, 1)
    permitted = F.filter(
        F.split(letters, ""), lambda ch: (ch != "") & (allowed.isNull() | F.array_contains(allowed, ch))
    )
    return F.coalesce(F.get(permitted, F.lit(0)), F.lit(""))


def after_preamble(text) -> Column:
    """Text after the first colon, trimmed; unchanged (but trimmed) without one."""
    return strip(F.regexp_replace(col_of(text), r"(?s)^[^:]*:", ""))


# ---- verdict JSON -----------------------------------------------------------

VERDICT = T.StructType(
    [
        T.StructField("score_justification", T.StringType()),
        T.StructField("semantic_relevance_rating", T.StringType()),
        T.StructField("missed_key_concepts", T.BooleanType()),
        T.StructField("hallucination_detected", T.BooleanType()),
        T.StructField("cheating_detected", T.BooleanType()),
    ]
)


def repair_backslashes(text) -> Column:
    r"""Double every backslash that does not start a JSON escape."""
    return F.regexp_replace(col_of(text), r'\\(?![\\/"bfnrtu])', r"\\\\")


def parse_verdict(text, schema: T.StructType = VERDICT) -> Column:
    """Parse a verdict; if that fails, repair the backslashes and parse again.

    Null means both attempts failed. Corrupt input is told apart from empty
    objects by a marker column that from_json fills on a parse failure.
    """
    text = strip(col_of(text))
    probe = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])

    def attempt(t: Column) -> Column:
        parsed = F.from_json(t, probe, {"columnNameOfCorruptRecord": "_bad"})
        ok = parsed.isNotNull() & parsed["_bad"].isNull()
        return F.when(ok, F.struct(*[parsed[f.name].alias(f.name) for f in schema.fields]))

    return F.coalesce(attempt(text), attempt(repair_backslashes(text)))


# fixed value: the object that a score reply holds
SCORE_OBJECT = r'(?s)(\{[^{}]*"score"[^{}]*\})'


def parse_score_reply(text, max_points, cfg: Thresholds = DEFAULTS) -> Column:
    """Score object inside a free reply: clamp, round, truncate; ai_error otherwise."""
    cleaned = strip(F.regexp_replace(strip(col_of(text)), r"(?s)<think>.*?</think>", ""))
    found = F.regexp_extract(cleaned, SCORE_OBJECT, 1)
    body = F.when(found != "", found).otherwise(cleaned)
    schema = "score string, confidence string, explanation string, _bad string"
    data = F.from_json(body, schema, {"columnNameOfCorruptRecord": "_bad"})
    ok = data.isNotNull() & data["_bad"].isNull() & body.startswith("{")
    confidence = clamp(safe_double(data["confidence"], 0.5), 0.0, 1.0)
    good = F.struct(
        round_half_up(clamp(safe_double(data["score"]), 0.0, col_of(max_points).cast("double")), 2).alias(
            "score"
        ),
        round_half_up(confidence, 3).alias("confidence"),
        F.lit("ai_graded").alias("status"),
        F.coalesce(data["explanation"], F.lit("")).alias("explanation"),
        (confidence < F.lit(cfg.high_confidence)).alias("needs_review"),
    )
    bad = F.struct(
        F.lit(0.0).alias("score"),
        F.lit(0.0).alias("confidence"),
        F.lit("ai_error").alias("status"),
        F.concat(F.lit("Invalid AI output: "), body).alias("explanation"),
        F.lit(True).alias("needs_review"),
    )
    return F.when(ok, good).otherwise(bad)


def mentions_safety_phrase(text) -> Column:
    lowered = F.lower(F.coalesce(col_of(text), F.lit("")))
    found = F.lit(False)
    for phrase in SAFETY_PHRASES:
        found = found | F.contains(lowered, F.lit(phrase))
    return found


# fixed value: what may stand before a list item
BULLET_MARKS = "-•*0123456789. "


def bullet_lines(text, limit: int = 3) -> Column:
    """Bullets of a reply: its JSON ``bullets``, else lines without list marks. The summary shows the first ``limit``
    of them; that is its definition, not a cap on work."""
    text = F.coalesce(col_of(text), F.lit(""))
    parsed = F.from_json(text, "bullets array<string>")["bullets"]
    listed = F.filter(F.coalesce(parsed, F.array().cast("array<string>")), lambda x: ~is_blank_text(x))
    lines = F.transform(
        F.split(text, r"\R"),
        lambda ln: strip(F.ltrim(strip(ln), F.lit(BULLET_MARKS))),
    )
    lines = F.filter(lines, lambda ln: F.length(ln) > 5)
    return F.slice(F.when(F.size(listed) > 0, listed).otherwise(lines), 1, limit)


# ---- mojibake ---------------------------------------------------------------

# The 27 characters of code page 1252 above ASCII that differ from
# Latin-1, and the byte each one stands for.
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = bytes(
    [0x80, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x8B, 0x8C, 0x8E, 0x91,
     0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0x9B, 0x9C, 0x9E, 0x9F]
)


def repair_mojibake(text) -> Column:
    """Undo UTF-8 read as code page 1252, then spell dashes and quotes in ASCII.

    Stays in the JVM: the special characters are mapped onto their byte values,
    the text is written as Latin-1 and the bytes are checked as UTF-8.
    """
    text = col_of(text)
    as_latin = F.translate(text, CP1252_CHARS, CP1252_BYTES.decode("latin-1"))
    encodable = ~text.rlike(r"[\x{80}-\x{9F}]") & ~as_latin.rlike(r"[^\x{00}-\x{FF}]")
    raw = F.encode(F.when(encodable, as_latin), "ISO-8859-1")
    recovered = F.coalesce(F.try_validate_utf8(raw.cast("string")), text)
    plain = F.translate(recovered, "—–“”‘’", "--\"\"''")
    return F.replace(plain, F.lit("…"), F.lit("..."))


# ---- small ones -------------------------------------------------------------


def type_code(long_name) -> Column:
    pairs = [F.lit(x) for kv in TYPE_CODES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col_of(long_name))


def type_name(code) -> Column:
    pairs = [F.lit(x) for name, short in TYPE_CODES.items() for x in (short, name)]
    return F.try_element_at(F.create_map(*pairs), col_of(code))


def exam_code_parts(exam_id) -> Column:
    """Course code and type of ``4064-midterm-2026``, with defaults."""
    eid = F.coalesce(col_of(exam_id), F.lit("exam-2026"))
    parts = F.split(eid, "-", -1)
    return F.struct(
        F.coalesce(F.get(parts, F.lit(0)), F.lit("0000")).alias("course_code"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("midterm")).alias("exam_type"),
    )


def composite_student_number(course_code, sequence) -> Column:
    """``24`` + two course digits + six-digit sequence."""
    prefix = F.lpad(F.substring(digits_only(course_code), 1, 2), 2, "0")
    return F.concat(F.lit("24"), prefix, F.lpad(col_of(sequence).cast("string"), 6, "0"))


def image_bytes(data_uri) -> Column:
    """Bytes behind a base64 text, with or without a data-URI prefix."""
    uri = F.nullif(col_of(data_uri), F.lit(""))
    payload = F.when(F.contains(uri, F.lit(",")), F.regexp_extract(uri, r"(?s)^[^,]*,(.*)$", 1)).otherwise(uri)
    return F.try_to_binary(payload, F.lit("base64"))


def fingerprint(request: Column) -> Column:
    return F.md5(F.to_json(request))


def iso_utc(ts) -> Column:
    return F.date_format(col_of(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def is_safe_image_name(name) -> Column:
    n = F.coalesce(col_of(name), F.lit(""))
    return n.rlike(r"^[A-Za-z0-9_.-]+\.jpg$") & ~F.contains(n, F.lit(".."))


def page_image_name(student_number, page) -> Column:
    return F.concat(
        F.translate(col_of(student_number), "?", "X"),
        F.lit("_page"),
        col_of(page).cast("string"),
        F.lit(".jpg"),
    )


def fallback_student_number(number, student_idx) -> Column:
    return F.coalesce(
        F.nullif(col_of(number), F.lit("")),
        F.concat(F.lit("unknown_"), (col_of(student_idx) + 1).cast("string")),
    )


def first_known(*ids, default: str = "unknown") -> Column:
    return F.coalesce(*[F.nullif(col_of(i), F.lit("")) for i in ids], F.lit(default))


def highlight_class(status) -> Column:
    """Colour class of a score cell."""
    s = col_of(status)
    return (
        F.when(s == "correct", "success")
        .when(s.isin("wrong", "partial"), "error")
        .when(s.isin("pending_review", "blank", "ai_flagged", "pending_ai"), "warning")
        .otherwise("none")
    )
