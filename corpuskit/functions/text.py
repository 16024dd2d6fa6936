"""Text column functions. All are native expressions: no Python per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: every character Python's str.split() treats as white space,
# written so that both Java and RE2 read it the same way.
WHITESPACE = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NOT_BLANK = WHITESPACE.replace("[", "[^", 1)
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Fixed values.
TEXT_LIMIT = 50_000
TRUNCATION_NOTE = "\n\n[... document truncated at {limit:,} characters ...]"
TITLE_LIMIT = 60
TITLE_KEEP = 57


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def strip(column: Column | str) -> Column:
    """Trim all Unicode white space (Spark's own default trims blanks only)."""
    return F.btrim(_c(column), F.lit(BLANKS))


# Java tests a class' parts in turn: most characters are none of white space by the
# first test, and a blank alone stays as it is.
_BLANK, _OTHER = rf"[[^!-~]&&{WHITESPACE}]", rf"[[^ -~]&&{WHITESPACE}]"


def collapse(column: Column | str) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(_c(column), f" {_BLANK}+|{_OTHER}{_BLANK}*", " "))


def squash(column: Column | str) -> Column:
    """`collapse` in lower case, the form quotes are compared in."""
    return F.lower(collapse(column))


def blank_to_null(column: Column | str) -> Column:
    """Empty string counts as absent."""
    return F.nullif(_c(column), F.lit(""))


def is_blank(column: Column | str) -> Column:
    return ~F.coalesce(F.rlike(_c(column), F.lit(NOT_BLANK)), F.lit(False))


def empty_to_null(column: Column | str) -> Column:
    """An empty list on an applicability column means unrestricted: store NULL."""
    column = _c(column)
    return F.when(F.size(column) > 0, column)


def guid_to_id(column: Column | str) -> Column:
    """Element ids carry at most one leading underscore that chunk ids drop."""
    return F.regexp_replace(_c(column), "^_", "")


# -- applicability attributes -------------------------------------------------

def _items(column: Column | str) -> Column:
    return F.split(F.coalesce(_c(column), F.lit("")), ",")


def building_classes(column: Column | str) -> Column:
    """'Class 2, Class 9c' -> ['2', '9c']; blank items go."""
    kept = F.filter(_items(column), lambda item: strip(item) != "")
    return F.transform(kept, lambda item: strip(F.regexp_replace(strip(item), "^Class ", "")))


def climate_zones(column: Column | str) -> Column:
    """First run of digits of every item, as integers; items without one go."""
    digits = F.transform(_items(column), lambda item: F.regexp_extract(item, r"\d+", 0))
    return F.transform(F.filter(digits, lambda d: d != ""), lambda d: d.cast("int"))


def one_jurisdiction(*states: Column | str) -> Column:
    """First non-empty state as a one-item list, else NULL (national)."""
    state = F.coalesce(*[blank_to_null(s) for s in states])
    return F.when(state.isNotNull(), F.array(state))


# -- file names ---------------------------------------------------------------

def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def stem(path: Column | str) -> Column:
    """Base name without its last suffix; a leading dot does not start a suffix."""
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]*$", "$1")


def suffix(path: Column | str) -> Column:
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def safe_name(column: Column | str) -> Column:
    return F.regexp_replace(_c(column), "[^A-Za-z0-9._-]", "_")


# Fixed patterns: figure numbers in file names and in headings.
FIGURE_FILE = r"(?i)^figure-(.+?)\.png$"
FIGURE_HEADING = rf"(?i)^figure{WHITESPACE}+([A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*)"


def figure_number_from_file(name: Column | str) -> Column:
    return blank_to_null(F.regexp_extract(_c(name), FIGURE_FILE, 1))


def figure_number_from_heading(heading: Column | str) -> Column:
    return blank_to_null(F.regexp_extract(strip(heading), FIGURE_HEADING, 1))


# -- composed text ------------------------------------------------------------

def _stacked(*parts: Column) -> Column:
    present = F.filter(F.array(*[strip(p) for p in parts]), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(present, "\n\n")


def figure_text(title: Column | str, description: Column | str) -> Column:
    """Title, blank line, description; whichever is blank is left out."""
    return _stacked(_c(title), _c(description))


def embedding_content(text: Column | str, heading: Column | str, with_heading: bool = False) -> Column:
    body = F.coalesce(_c(text), F.lit(""))
    if not with_heading:
        return body
    head = blank_to_null(heading)
    return F.when(head.isNotNull(), F.concat(head, F.lit("\n\n"), body)).otherwise(body)


def truncate_document(text: Column | str, limit: int = TEXT_LIMIT) -> Column:
    """Cut at `limit` characters and say so. Feature of the attachment reader."""
    body = strip(text)
    note = TRUNCATION_NOTE.format(limit=limit)
    return F.when(F.length(body) > limit, F.concat(F.substring(body, 1, limit), F.lit(note))).otherwise(body)


def chat_title(text: Column | str) -> Column:
    text = _c(text)
    short = F.concat(F.substring(text, 1, TITLE_KEEP), F.lit("…"))
    return F.when(F.length(text) > TITLE_LIMIT, short).otherwise(text)


def numbered_heading(kind: str, number: Column | str, title: Column | str) -> Column:
    """'Table 3: Loads', or the title alone, or 'Table 3', or NULL."""
    number, title = blank_to_null(number), blank_to_null(title)
    label = F.concat(F.lit(f"{kind} "), number)
    return F.coalesce(F.concat(label, F.lit(": "), title), title, label)


def spaced_label(*parts: Column | str) -> Column:
    """Non-empty parts joined by a blank, NULL when there are none."""
    return blank_to_null(F.concat_ws(" ", *[blank_to_null(p) for p in parts]))


def definition_line(term: Column | str, definition: Column | str) -> Column:
    return F.concat(_c(term), F.lit(": "), _c(definition))


# Message roles as the answering model names them.
MODEL_ROLES = {"user": "user", "assistant": "model"}


def model_role(role: Column | str) -> Column:
    pairs = [F.lit(x) for pair in MODEL_ROLES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _c(role)), F.lit("user"))


# -- citable blocks -----------------------------------------------------------

def _applicability(chunk) -> Column:
    zones = F.transform(chunk("climate_zones"), lambda z: z.cast("string"))

    def named(label: str, values: Column) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.array_join(values, ", ")))

    listed = F.concat_ws(
        "; ",
        named("building classes", chunk("building_classes")),
        named("jurisdictions", chunk("jurisdictions")),
        named("climate zones", zones),
        blank_to_null(chunk("applicability_note")),
    )
    return F.when(listed != "", F.concat(F.lit("Applicability: "), listed))


def _block(opening: str, dash: str, chunk) -> list[Column]:
    heading = blank_to_null(chunk("heading"))
    title = F.concat(
        F.lit(opening),
        F.coalesce(blank_to_null(chunk("clause_id")), F.lit("unknown clause")),
        F.lit(f" {dash} "),
        F.coalesce(blank_to_null(chunk("doc")), F.lit("unknown document")),
        F.coalesce(F.concat(F.lit(": "), heading), F.lit("")),
        F.lit("]"),
    )
    return [title, F.coalesce(chunk("text"), F.lit("")), _applicability(chunk)]


def context_block(chunk=F.col) -> Column:
    """One retrieved chunk as citable context, with its standards hand-off line."""
    names = F.transform(chunk("standard_refs"), lambda r: strip(F.coalesce(r["standard"], F.lit("?"))))
    handoff = F.when(
        F.size(chunk("standard_refs")) > 0,
        F.concat(F.lit("Australian Standard hand-off: "), F.array_join(names, ", ")),
    )
    return F.concat_ws("\n", *_block("[", "—", chunk), handoff)


def requirement_block(chunk=F.col) -> Column:
    """One retrieved chunk as a labelled requirement."""
    return F.concat_ws("\n", *_block("[clause_id: ", "--", chunk))
