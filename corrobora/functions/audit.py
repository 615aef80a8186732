"""Sentence-level predicates of the report audit, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corrobora import vocab
from corrobora.functions.text import contains_any, strip


def _by_letter(pattern: str) -> str:
    """The same test with the words under their first letters: most places are passed by after one look.

    For a pattern ``(?i)\\b(word|word|...)\\b`` whose words all begin with a plain letter.
    """
    words, depth, groups = [""], 0, {}
    for c in pattern.removeprefix(r"(?i)\b(").removesuffix(r")\b"):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            words.append("")
        else:
            words[-1] += c
    for word in words:
        groups.setdefault(word[0], []).append(word[1:])
    branches = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in groups.items())
    return rf"(?i)\b(?=[{''.join(groups)}])(?:{branches})\b"


# Every object reference begins with a capital letter.
_REF = "(?=[A-Z])" + vocab.OBJECT_REF
_ASSERTIVE = _by_letter(vocab.ASSERTIVE)


def _boxed(sentence: Column) -> Column:
    """Bracketed ids; the pattern runs only where there is a bracket."""
    return F.when(F.contains(sentence, F.lit("[")), F.regexp_extract_all(sentence, F.lit(vocab.CITATION), F.lit(1))) \
        .otherwise(F.array().cast("array<string>"))


def object_refs(sentence: Column) -> Column:
    """Object references as they stand, repeats included."""
    return F.regexp_extract_all(sentence, F.lit(_REF), F.lit(1))


def citations(sentence: Column) -> Column:
    """Distinct ids a sentence cites: bracketed ids and bare object references."""
    return F.array_union(_boxed(sentence), object_refs(sentence))


def bracketed(sentence: Column) -> Column:
    """Distinct bracketed ids only."""
    return F.array_distinct(_boxed(sentence))


def prose_ids(body: Column) -> Column:
    """Distinct ids cited in a body before its reference list."""
    prose = F.substring_index(body, "\n## References", 1)
    return F.array_distinct(F.regexp_extract_all(prose, F.lit(vocab.PROSE_ID), F.lit(1)))


def cited_figures(text: Column) -> Column:
    """Figure ids in citation brackets, in order, each once."""
    groups = F.regexp_extract_all(text, F.lit(vocab.FIGURE_GROUP), F.lit(1))
    ids = F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))
    return F.array_distinct(F.flatten(ids))


def is_cited(sentence: Column) -> Column:
    return F.rlike(sentence, F.lit(vocab.CITATION + "|" + vocab.OBJECT_REF))


def is_assertive(sentence: Column) -> Column:
    return F.rlike(sentence, F.lit(_ASSERTIVE))


def is_hedged(sentence: Column) -> Column:
    return contains_any(F.lower(sentence), vocab.HEDGES)


def first_word(sentence: Column) -> Column:
    """First word behind any list mark, lower case, without emphasis marks."""
    bare = F.regexp_replace(strip(sentence), vocab.LIST_PREFIX, "")
    word = F.element_at(F.split(F.lower(bare), r"[\s,:]+", 2), 1)
    return F.regexp_replace(word, r"^[*_]+|[*_]+$", "")


def is_recommendation(sentence: Column) -> Column:
    """An imperative opener, or a modal such as should or must anywhere."""
    opener = first_word(sentence).isin(*vocab.IMPERATIVES)
    return opener | F.rlike(sentence, F.lit(vocab.MODAL_RECOMMENDATION))


def is_meta(sentence: Column) -> Column:
    """A statement about the document and its evidence, not about the world."""
    return (F.rlike(sentence, F.lit(vocab.META_SUBJECT))
            & F.rlike(sentence, F.lit(vocab.META_PREDICATE)))


def is_condition(sentence: Column) -> Column:
    """Opens on a condition, or states what would refute a forecast."""
    s = strip(sentence)
    return F.rlike(s, F.lit(vocab.CONDITIONAL_OPENER)) | F.rlike(s, F.lit(vocab.FALSIFIER_CLAUSE))


def is_unsourced(sentence: Column, cited: Column | None = None, simple: bool = False) -> Column:
    """A factual assertion with no citation and no exemption.

    The tests run from cheap to dear and stop at the first that settles it.
    ``simple`` is the form used on benchmark texts: the exemptions for
    statements about the document and for conditions do not apply.
    """
    cited = is_cited(sentence) if cited is None else cited
    bare = ~cited & is_assertive(sentence) & ~is_hedged(sentence) & ~is_recommendation(sentence)
    return bare if simple else bare & ~is_meta(sentence) & ~is_condition(sentence)


def unknown_opener(sentence: Column) -> Column:
    """First word when it is alphabetic and no known imperative, else null."""
    bare = F.regexp_replace(strip(sentence), vocab.LIST_PREFIX, "")
    word = F.element_at(F.split(F.lower(bare), r"[\s,:;]+"), 1)
    word = F.regexp_replace(word, r"""^[*_.()"']+|[*_.()"']+$""", "")
    known = word.isin(*vocab.IMPERATIVES)
    return F.when(F.rlike(word, F.lit(r"^\p{L}+$")) & ~known, word)


def is_gate_disclosure(sentence: Column) -> Column:
    """Names a gate as needing validation or being open, and claims no deficit."""
    low = F.lower(sentence)
    has = lambda p: F.rlike(low, F.lit(p))
    named = (has(vocab.GATE_WORD) & (has(vocab.GATE_VALIDATES) | has(vocab.GATE_STATE))
             & ~has(vocab.DEFICIT_WORD))
    return (F.contains(low, F.lit("customer validation"))
            | F.contains(low, F.lit("validation required")) | named)


def is_gap_claim(sentence: Column) -> Column:
    """Deficit language within reach of a national subject."""
    subject = contains_any(F.lower(sentence), vocab.NATIONAL_SUBJECTS)
    return subject & F.rlike(sentence, F.lit(vocab.GAP_LANGUAGE)) & ~is_gate_disclosure(sentence)


def marks_construct(sentence: Column) -> Column:
    return contains_any(F.lower(sentence), vocab.CONSTRUCT_MARKERS)


# --- splitting a body ---------------------------------------------------------------

def sentences_of(block: Column) -> Column:
    """Candidate assertions of a markdown block that holds no heading logic.

    Scaffolding lines, url lines, bold-only lines and condition-labelled parts
    are dropped; list marks and labels come off; short parts are dropped.
    """
    lines = F.transform(F.split(block, r"\r?\n"), strip)
    kept = F.filter(lines, lambda l: (l != "") & ~F.rlike(l, F.lit(vocab.SKIP_LINE))
                    & ~F.contains(l, F.lit("http://")) & ~F.contains(l, F.lit("https://")))
    # The patterns of marks run only on what begins with such a mark.
    begins = lambda l, *marks: F.left(l, F.lit(1)).isin(*marks)
    unbullet = lambda l: F.when(begins(l, *"-*+"), F.regexp_replace(l, vocab.LIST_MARK, "")).otherwise(l)
    unnumber = lambda l: F.when(begins(l, *"0123456789"), F.regexp_replace(l, vocab.LIST_NUMBER, "")).otherwise(l)
    unmarked = F.transform(F.transform(kept, unbullet), unnumber)
    prose = F.filter(unmarked, lambda l: ~(F.startswith(l, F.lit("**")) & F.rlike(l, F.lit(vocab.BOLD_HEADING))))
    parts = F.flatten(F.transform(prose, lambda l: F.transform(
        F.split(l, r"(?<=[.!?])\s+(?=[A-Z\[])"), strip)))
    claims = F.filter(parts, lambda p: ~F.rlike(p, F.lit(vocab.CONDITION_LABEL)))
    unbold = lambda p: F.when(F.startswith(p, F.lit("**")), F.regexp_replace(p, vocab.BOLD_LABEL, "")).otherwise(p)
    bare = F.transform(F.transform(claims, unbold), lambda p: strip(F.regexp_replace(p, vocab.LABEL, "")))
    return F.filter(bare, lambda p: F.length(p) > 25)


def section_blocks(body: Column) -> Column:
    """``array<struct<title, text>>`` split at ``## `` lines.

    The text before the first heading comes with a null title, and is left out
    when the body opens on a heading.
    """
    raw = F.split(F.coalesce(body, F.lit("")), r"(?m)^## ")
    cut = F.transform(raw, lambda b, i: F.struct(
        F.when(i > 0, strip(F.substring_index(b, "\n", 1))).alias("title"),
        F.when(i > 0, F.regexp_replace(b, r"^[^\n]*\n?", "")).otherwise(b).alias("text")))
    return F.filter(cut, lambda s: s["title"].isNotNull() | (s["text"] != ""))


def heading_blocks(text: Column, title: Column) -> Column:
    """``array<struct<in_references, text>>`` split at every heading line.

    A block belongs to the reference list when the heading that opens it says
    "reference"; the first block inherits the section title.
    """
    raw = F.split(text, r"(?m)^(?=[ \t]*#)")
    said = lambda b, i: F.when((i == 0) & ~F.rlike(b, F.lit(r"^\s*#")), F.coalesce(title, F.lit(""))) \
        .otherwise(F.substring_index(b, "\n", 1))
    return F.transform(raw, lambda b, i: F.struct(
        F.contains(F.lower(said(b, i)), F.lit("reference")).alias("in_references"), b.alias("text")))
