r"""Form fields that a page reader took for formulas, back to plain text; real formulas stay as they are.

A span between dollar signs is flattened when it has no mark of mathematics, has a mark of a form, and nothing but plain
text is left of it. Native column expressions; a text without a dollar sign is passed by.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Macros that only mathematics uses, words and macros of forms, what each macro of a form becomes, look-alikes.
MATH_MACROS = (
    "sum prod int oint lim sqrt partial nabla infty forall exists alpha beta gamma delta theta lambda mu sigma pi omega Delta Omega leq geq neq approx equiv "
    "propto subset cup cap to rightarrow mapsto left right binom matrix vec hat bar log ln exp sin cos tan perp pm"
).split()
FORM_WORDS = "Tag Monat Jahr Datum Geburtsdatum Buchungsdatum Storno ICD-10 ICD10 Versicherungsnummer Vorname Nachname PLZ Bezeichnung".split()
FORM_MACROS = "underline overline underbrace checkmark".split()
LAYOUT = (r"\\begin\{array\}(?:\{[^{}]*\})?|\\end\{array\}|\\hline", r"\\\\")
STEPS = (
    (r"\\checkmark", " [x] "),
    (r"\\underbrace\{([^{}]*)\}_\{([^{}]*)\}", " $1 $2 "),
    (r"\\(?:underline|overline|text|mathrm|mathbf|textbf|textit)\{([^{}]*)\}", " $1 "),
    (r"_\{([^{}]*)\}", " $1 "),
    (r"_([A-Za-z0-9]+)", " $1 "),
    (r"\\frac\{([^{}]*)\}\{([^{}]*)\}", " $1 $2 "),
)
ROUNDS = 12
SPACERS = r"\\qquad|\\quad|\\atop|\\cdot|\\[,;!: ]"
LOOK_ALIKES = ("．․○◯〇", "..000")

SPAN = r"(?s)\$\$.*?\$\$|\$.*?\$"
VETO = r"\^|\\(?:" + "|".join(MATH_MACROS) + ")(?:[^A-Za-z]|$)"
FORM = r"\\(?:" + "|".join(FORM_MACROS) + r")\b|\b(?:" + "|".join(FORM_WORDS) + r")\b"


def is_form(inner: Column) -> Column:
    """No mark of mathematics (an environment other than array is one), and a mark of a form."""
    other = F.regexp_replace(inner, r"\\begin\{array\}", "").rlike(r"\\begin\{[A-Za-z*]+\}")
    return ~inner.rlike(VETO) & ~other & inner.rlike(FORM)


def flat(inner: Column) -> Column:
    """Macros unfolded from the inside out; closing braces without an opening one go."""
    for pattern in LAYOUT:
        inner = F.regexp_replace(inner, pattern, " ")
    for _ in range(ROUNDS):
        for pattern, becomes in STEPS:
            inner = F.regexp_replace(inner, pattern, becomes)
    return F.translate(F.regexp_replace(inner, SPACERS, " "), *LOOK_ALIKES)


def one_span(span: Column) -> Column:
    """The span's inner text, its flat form and whether that may take its place; evaluated once each by nested transforms."""
    edge = F.when(span.rlike(r"(?s)^\$\$.*\$\$$"), 2).otherwise(1)
    return F.struct(span.alias("span"), F.substring(span, edge + 1, F.length(span) - 2 * edge).alias("inner"))


def spans(text: Column) -> Column:
    """array of what each span of a text becomes: its plain text, or itself."""
    found = F.transform(F.regexp_extract_all(text, F.lit(SPAN), F.lit(0)), one_span)
    flattened = F.transform(found, lambda s: F.struct(s["span"].alias("span"), F.when(is_form(s["inner"]), flat(s["inner"])).alias("flat")))
    # An opening brace left over is a broken structure; closing ones alone are a harmless rest.
    plain = F.transform(flattened, lambda s: F.struct(s["span"].alias("span"), F.when(~s["flat"].contains("{"), F.replace(s["flat"], F.lit("}"), F.lit(""))).alias("flat")))
    fine = lambda s: s["flat"].isNotNull() & ~s["flat"].rlike(r"[\\$]") & s["flat"].rlike("[A-Za-z0-9]")
    return F.transform(plain, lambda s: F.when(fine(s), F.trim(F.regexp_replace(s["flat"], r"\s+", " "))).otherwise(s["span"]))


def flatten_forms(text: Column) -> tuple[Column, Column]:
    """(the text with its form spans as plain text, how many there were); null stays null."""
    new = spans(text)
    pieces = F.zip_with(F.split(text, SPAN, -1), new, lambda piece, span: F.concat(piece, F.coalesce(span, F.lit(""))))
    changed = F.size(F.filter(F.arrays_zip(new.alias("n"), F.regexp_extract_all(text, F.lit(SPAN), F.lit(0)).alias("o")), lambda p: p["n"] != p["o"]))
    has = text.contains("$")
    return F.when(has, F.array_join(pieces, "")).otherwise(text), F.when(has, changed).otherwise(F.when(text.isNotNull(), 0))
