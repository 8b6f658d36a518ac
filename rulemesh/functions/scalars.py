"""Scalar functions over columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weight names and their numbers.
WEIGHTS = {
    "thin": "100", "extralight": "200", "ultralight": "200", "light": "300", "regular": "400", "normal": "400",
    "medium": "500", "semibold": "600", "demibold": "600", "bold": "700", "extrabold": "800", "ultrabold": "800",
    "black": "900", "heavy": "900",
}
# Id prefixes and the kinds they stand for.
KINDS = {"rule_": "rule", "tok_": "token", "ast_": "asset", "sub_": "subtype", "tpl_": "template", "tgr_": "template_group", "agr_": "asset_group"}
# Token types by how their values are written.
COLOR_TYPES = ("color",)
DIMENSION_TYPES = ("dimension", "spacing", "padding", "margin", "size", "radius", "breakpoint")
WEIGHT_TYPES = ("fontweight", "weight", "font_weight")
NUMBER_TYPES = ("number", "opacity", "line_height", "letter_spacing")
RATIO_TYPES = ("ratio", "usage_ratio")

NUMBER = r"^-?\d+(?:\.\d+)?$"


def words(text: Column) -> Column:
    """Lower-case runs of a-z, 0-9 and #."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9#]+"), F.lit(0))


def slugify(text: Column, longest: int | None = 48) -> Column:
    """Lower-case words joined by _, cut to ``longest``; x if nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    if longest is not None:
        slug = F.regexp_replace(F.substring(slug, 1, longest), "_+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("x"))


def stable_hash(canonical: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-1 of a canonical string."""
    return F.substring(F.sha1(canonical), 1, 16)


def cache_key(*parts: Column) -> Column:
    """SHA-1 of the parts joined by |."""
    return F.sha1(F.concat_ws("|", *parts))


def color(raw: Column) -> Column:
    """#abc, #aabbcc and rgb(r, g, b) as #rrggbb in lower case; other texts trimmed; numbers above 255 give null."""
    text = F.trim(raw)
    three = F.regexp_extract(text, "^#([0-9a-fA-F]{3})$", 1)
    channels = [F.regexp_extract(text, r"(?i)^rgb\(\s*(\d{1,9})\s*,\s*(\d{1,9})\s*,\s*(\d{1,9})\s*\)$", k) for k in (1, 2, 3)]
    parts = [F.nullif(c, F.lit("")).cast("int") for c in channels]
    from_rgb = F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(p), 2, "0")) for p in parts])
    return (
        F.when(three != "", F.concat(F.lit("#"), F.lower(F.regexp_replace(three, "(.)", "$1$1"))))
        .when(text.rlike("^#[0-9a-fA-F]{6}$"), F.lower(text))
        .when(channels[0] != "", F.when(F.greatest(*parts) <= 255, from_rgb))
        .otherwise(text)
    )


def _plain(number: Column) -> Column:
    """Without zeros at the end of a fraction."""
    return F.when(number.contains("."), F.regexp_replace(F.regexp_replace(number, "0+$", ""), r"\.$", "")).otherwise(number)


def dimension(raw: Column) -> Column:
    """A number with its unit in lower case, px if none; other texts with single blanks; empty ones give null."""
    text = F.regexp_replace(F.trim(raw), r"\s+", " ")
    shape = r"(?i)^(-?\d+(?:\.\d+)?)\s*(px|pt|em|rem|%)?$"
    number, unit = F.regexp_extract(text, shape, 1), F.lower(F.regexp_extract(text, shape, 2))
    sized = F.concat(_plain(number), F.when(unit == "", "px").otherwise(unit))
    return F.when(text == "", None).when(number != "", sized).otherwise(text)


def weight(raw: Column) -> Column:
    """Font weights as numbers where known."""
    text = F.trim(raw)
    key = F.regexp_replace(F.lower(text), r"[\s_\-]+", "")
    named = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    digits = F.regexp_replace(text, r"^0+(?=\d)", "")
    return F.when(text.rlike(r"^\d+$"), digits).otherwise(F.coalesce(F.try_element_at(named, key), text))


def _float_text(number: Column) -> Column:
    """As Python writes a float of common size: at least one digit after the point."""
    text = _plain(F.format_string("%.12f", number))
    return F.when(text.contains("."), text).otherwise(F.concat(text, F.lit(".0")))


def number(raw: Column, ratio: bool = False) -> Column:
    """Percentages as shares, fractions without zeros at their end, whole numbers as they are; a:b stays for ratios."""
    text = F.trim(raw)
    percent = F.regexp_extract(text, r"^(-?\d+(?:\.\d+)?)\s*%$", 1)
    out = F.when(percent != "", _float_text(percent.try_cast("double") / 100))
    if ratio:
        a, b = (F.regexp_extract(text, r"^(\d{1,18})\s*:\s*(\d{1,18})$", k) for k in (1, 2))
        out = out.when(a != "", F.concat(a.try_cast("long").cast("string"), F.lit(":"), b.try_cast("long").cast("string")))
    return out.when(text.rlike(NUMBER) & text.contains("."), _float_text(text.try_cast("double"))).otherwise(text)


def verbatim(raw: Column) -> Column:
    return F.trim(raw)


def enum_text(raw: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(raw), r"\s+", " "))


def normalise(kind: Column, raw: Column) -> Column:
    """Canonical text of a raw value by its token type; applying it again changes nothing."""
    key = F.lower(kind)
    return (
        F.when(key.isin(*COLOR_TYPES), color(raw))
        .when(key.isin(*DIMENSION_TYPES), dimension(raw))
        .when(key.isin(*WEIGHT_TYPES), weight(raw))
        .when(key.isin(*NUMBER_TYPES), number(raw))
        .when(key.isin(*RATIO_TYPES), number(raw, ratio=True))
        .when(key.isin("preferred_form", "body", "template_body"), verbatim(raw))
        .otherwise(enum_text(raw))
    )


def literal(text: Column) -> Column:
    """A regular expression that matches ``text`` itself."""
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")


def value_pattern(kind: Column, canon: Column) -> Column:
    """A regular expression that accepts what the source may write for a canonical value."""
    key, bare = F.lower(kind), F.substring(canon, 2, 6)
    short = F.concat(*[F.substring(canon, k, 1) for k in (2, 4, 6)])
    doubled = F.concat(*[F.repeat(F.substring(canon, k, 1), 2) for k in (2, 4, 6)]) == bare
    forms = F.when(doubled, F.concat(bare, F.lit("|"), short)).otherwise(bare)
    number_ = literal(F.regexp_replace(canon, "(px|%)$", ""))
    names = F.create_map(*[
        F.lit(x)
        for value in dict.fromkeys(WEIGHTS.values())
        for x in (value, "|".join(sorted((n for n, v in WEIGHTS.items() if v == value), key=len, reverse=True)))
    ])
    named = F.coalesce(F.concat(F.lit("|"), F.try_element_at(names, canon)), F.lit(""))
    return (
        F.when(key.isin(*COLOR_TYPES) & canon.startswith("#"), F.concat(F.lit("(?i)#(?:"), forms, F.lit(")(?![0-9a-f])")))
        .when(key.isin(*DIMENSION_TYPES) & canon.endswith("px"), F.concat(F.lit(r"(?i)\b"), number_, F.lit(r"(?:\s*px)?\b")))
        .when(key.isin(*DIMENSION_TYPES) & canon.endswith("%"), F.concat(F.lit(r"\b"), number_, F.lit(r"\s*%(?!\w)")))
        .when(key.isin(*WEIGHT_TYPES), F.concat(F.lit(r"(?i)\b(?:"), literal(canon), named, F.lit(r")\b")))
        .when(key.isin(*NUMBER_TYPES, *RATIO_TYPES), F.concat(F.lit(r"(?<![\w.])"), number_, F.lit(r"(?![\w.])")))
        .otherwise(F.concat(F.lit("(?i)"), literal(canon)))
    )


def ids_in(text: Column) -> Column:
    """Entity ids that stand in a text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(?:tok|ast|sub|agr|tpl|tgr)_[a-z0-9_]+\b"), F.lit(0)))


def kind_of(id_: Column) -> Column:
    out = None
    for prefix, kind in KINDS.items():
        test = id_.startswith(prefix)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def context_key(audience: Column, surface: Column, campaign: Column, theme: Column, tags: Column) -> Column:
    """One text for a context; tags sorted."""
    pairs = [("audience", audience), ("surface", surface), ("campaign", campaign), ("theme", theme)]
    joined = [F.concat(F.lit(f"{name}="), value) for name, value in pairs]
    return F.concat_ws("|", *joined, F.concat(F.lit("tags="), F.array_join(F.array_sort(tags), ",")))


def group_of_ref(ref: Column) -> Column:
    """``name[3]`` as ``name_03``."""
    name, at = (F.regexp_extract(ref, r"^(.*)\[(\d{1,9})\]$", k) for k in (1, 2))
    return F.when(at != "", F.concat(slugify(name), F.lit("_"), F.lpad(at, F.greatest(F.length(at), F.lit(2)), "0"))).otherwise(slugify(ref))


def ref_order(ref: Column) -> Column:
    """(name, number) to sort ``name[3]`` by."""
    return F.struct(
        F.regexp_replace(ref, r"\[\d+\]$", "").alias("name"),
        F.coalesce(F.nullif(F.regexp_extract(ref, r"\[(\d{1,9})\]$", 1), F.lit("")).cast("int"), F.lit(-1)).alias("at"),
    )


def signed(delta: Column) -> Column:
    return F.format_string("%+d", delta.cast("long"))


def percent(share: Column) -> Column:
    return F.concat(F.format_string("%.1f", share * 100), F.lit("%"))


def shortened(text: Column, longest: int = 160) -> Column:
    """The first characters, with ... where more follow."""
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("..."))).otherwise(text)


def cell(text: Column) -> Column:
    """A text as a Markdown table cell."""
    return F.replace(F.replace(text, F.lit("|"), F.lit(r"\|")), F.lit("\n"), F.lit(" "))


def unix_lines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def vocabulary_line(line: Column) -> tuple[Column, Column]:
    """(name, description) of a line ``- name: description``; nulls for other lines."""
    parts = [F.nullif(F.regexp_extract(line, r"^- ([a-z_]+): (.+)$", k), F.lit("")) for k in (1, 2)]
    return parts[0], parts[1]


def stages(span: Column) -> Column:
    """``s2..s5`` as the names between."""
    low, high = (F.regexp_extract(span, r"^s(\d{1,3})(?:\.\.s(\d{1,3}))?$", k) for k in (1, 2))
    last = F.when(high == "", low).otherwise(high)
    numbers = F.sequence(F.nullif(low, F.lit("")).cast("int"), F.nullif(last, F.lit("")).cast("int"))
    return F.transform(numbers, lambda n: F.concat(F.lit("s"), n.cast("string")))


def hash_time(hash_: Column, start: int = 946684800, span: int = 20 * 365 * 86400) -> Column:
    """A second between ``start`` and ``start + span`` that depends on a hexadecimal hash only."""
    return F.conv(F.substring(hash_, 1, 8), 16, 10).cast("long") % span + start


# Fixed value: a quoted stretch, in plain or curly quotes.
QUOTED = "\"([^\"]+)\"|'([^']+)'|“([^”]+)”|‘([^’]+)’"


def has_long_quote(text: Column, least: int = 8) -> Column:
    """Whether a quoted stretch, in any kind of quotes, has ``least`` words."""
    spans = F.regexp_extract_all(text, F.lit(QUOTED), F.lit(0))
    return F.exists(spans, lambda s: F.regexp_count(F.substr(s, F.lit(2), F.length(s) - 2), F.lit(r"(?U)\S+")) >= least)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, in double precision; null for a zero vector."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def placeholders(text: Column) -> Column:
    """Names in braces, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{([a-zA-Z_]\w*)\}"), F.lit(1)))


def comments(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?s)<!--(.*?)-->"), F.lit(1))


def page_of(text: Column, offset: int, size: int = 40_000) -> tuple[Column, Column]:
    """A text's characters from ``offset`` on, and whether more follow."""
    return F.substring(text, offset + 1, size), F.length(text) > offset + size


def mode_file(axis: Column, value: Column) -> Column:
    return F.concat(slugify(axis, None), F.lit("."), slugify(value, None), F.lit(".json"))
