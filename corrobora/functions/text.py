"""Text predicates and normalisers as Column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corrobora import vocab

# Quote marks, dashes and the no-break space that publishers vary, and their
# plain forms (fixed values).
_FANCY = "‘’“”–— "
_PLAIN = "''\"\"-- "


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once.

    A Column is an expression, not a variable: used twice, it runs twice.  The
    one-element transform binds it.
    """
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with costly columns that run once per row.

    A later filter on an ordinary column is pushed below it, which evaluates the
    expression twice; a generator is a fence the filter does not cross.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def attach(df: DataFrame, *one_row: DataFrame) -> DataFrame:
    """``df`` with the columns of one-row frames, as scalar subqueries (no join)."""
    for i, other in enumerate(one_row):
        df = df.withColumn(f"_r{i}", other.select(F.struct("*")).scalar()).select("*", f"_r{i}.*").drop(f"_r{i}")
    return df


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col, F.lit(" \t\n\r\f\x0b"))


def squash(col: Column) -> Column:
    """Collapse white space runs to one blank and trim."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def contains_any(col: Column, terms) -> Column:
    """True when any of the fixed terms occurs in the text."""
    out = F.lit(False)
    for term in terms:
        out = out | F.contains(col, F.lit(term))
    return out


def letters(col: Column) -> Column:
    """Lower-case letters and digits only: the form quotes are compared in."""
    folded = F.translate(F.lower(F.coalesce(col, F.lit(""))), _FANCY, _PLAIN)
    return F.regexp_replace(folded, "[^a-z0-9]", "")


def within(part_letters: Column, whole_letters: Column) -> Column:
    """Verbatim containment of two texts already reduced by :func:`letters`."""
    return (F.length(part_letters) >= 3) & F.contains(whole_letters, part_letters)


def hook_in_claim(hook: Column, claim: Column) -> Column:
    """Looser containment: case and spacing folded, at least three characters."""
    plain = lambda c: squash(F.translate(F.lower(F.coalesce(c, F.lit(""))), "’", "'"))
    probe = F.regexp_replace(plain(hook), "^[ .,'\"]+|[ .,'\"]+$", "")
    return (F.length(probe) >= 3) & F.contains(plain(claim), probe)


# Character entities that pages use, and what they stand for (fixed values);
# the ampersand comes last so that no entity is unescaped twice.
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
             ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _code_point(ref: Column) -> Column:
    """The sign of a numeric reference such as ``#233`` or ``#xE9``; what is no sign becomes U+FFFD."""
    hexed = F.rlike(ref, F.lit("^#[xX]"))
    digits = F.regexp_replace(F.regexp_replace(ref, "^#[xX]?", ""), "^0+(?=.)", "")
    number = (F.when(F.length(digits) > 8, F.lit(-1).cast("long")).when(hexed, F.conv(digits, 16, 10).cast("long"))
              .otherwise(digits.cast("long")))
    sign = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    wide = F.lpad(F.hex(F.when(sign, number).otherwise(F.lit(0xFFFD).cast("long"))), 8, "0")
    return F.decode(F.unhex(wide), "UTF-32")


def numeric_references(col: Column) -> Column:
    """Numeric character references as the signs they stand for."""
    pattern = "&(#[xX][0-9a-fA-F]+|#[0-9]+);"
    def spell(x: Column) -> Column:
        refs = F.regexp_extract_all(x, F.lit(pattern), F.lit(1))
        return F.array_join(F.zip_with(F.split(x, pattern, -1), refs, lambda part, ref: F.concat(part, F.when(ref.isNotNull(), _code_point(ref)).otherwise(""))), "")
    return F.when(F.contains(col, F.lit("&#")), let(col, spell)).otherwise(col)


def unescape(col: Column) -> Column:
    col = numeric_references(col)
    for entity, char in _ENTITIES:
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


# A comment, a script or style with its content, a tag, a stretch of text, a lone sign.
_MARKUP = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<[a-z/!?][^>]*>|[^<]+|<"


def tokens(html: Column) -> Column:
    """The page as an array of tags, comments, whole scripts and styles, and stretches of text."""
    return F.regexp_extract_all(html, F.lit(_MARKUP), F.lit(0))


def elements(parts: Column, tags) -> Column:
    """``array<struct<a, b>>``: first and last token of the outermost elements of the given names.

    The running depth of the open element's own name tells its end, so equal tags may be
    nested.  An element that never ends is none.
    """
    names = "|".join(tags)
    name = lambda x: F.lower(F.regexp_extract(x, rf"(?i)^</?({names})\b", 1))
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("depth"), F.lit(0).alias("from"), F.lit(0).alias("at"),
                     F.array().cast("array<struct<a:int,b:int>>").alias("found"))

    def step(acc: Column, token: Column) -> Column:
        at = acc["at"] + 1
        def state(open_: Column, depth: Column, from_: Column, found: Column) -> Column:
            return F.struct(open_.alias("open"), depth.alias("depth"), from_.alias("from"), at.alias("at"), found.alias("found"))
        def moved(tag: Column) -> Column:
            closes = F.startswith(token, F.lit("</"))
            # a script or style is a token of its own, a tag may close itself
            whole = F.rlike(token, F.lit(r"(?is)^<(script|style)\b.*</\1\s*>$|/>$"))
            none = state(acc["open"], acc["depth"], acc["from"], acc["found"])
            alone = state(F.lit(""), F.lit(0), F.lit(0), F.array_append(acc["found"], F.struct(at.alias("a"), at.alias("b"))))
            opened = state(tag, F.lit(1), at, acc["found"])
            deeper = state(acc["open"], acc["depth"] + F.when(closes, -1).otherwise(1), acc["from"], acc["found"])
            ended = state(F.lit(""), F.lit(0), F.lit(0), F.array_append(acc["found"], F.struct(acc["from"].alias("a"), at.alias("b"))))
            return (F.when(tag == "", none)
                    .when(acc["open"] == "", F.when(closes, none).when(whole, alone).otherwise(opened))
                    .when((tag != acc["open"]) | whole, none)
                    .when(closes & (acc["depth"] == 1), ended).otherwise(deeper))
        plain = state(acc["open"], acc["depth"], acc["from"], acc["found"])
        return F.when(F.startswith(token, F.lit("<")), let(name(token), moved)).otherwise(plain)

    return F.aggregate(parts, start, step, lambda acc: acc["found"])


def html_title(html: Column, url: Column) -> Column:
    """Text of the title element, or the url when there is none."""
    title = strip(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.when(title == "", url).otherwise(title)


def drop_elements(html: Column, tags) -> Column:
    """Markup without comments and without the given elements, whatever is nested in them."""
    def kept(parts: Column) -> Column:
        def between(cut: Column) -> Column:
            edges = F.concat(F.array(F.lit(0)), F.transform(cut, lambda c: c["b"]))
            stops = F.concat(F.transform(cut, lambda c: c["a"]), F.array(F.size(parts) + 1))
            return F.array_join(F.zip_with(edges, stops, lambda a, b: F.array_join(F.slice(parts, a + 1, b - a - 1), "")), " ")
        return let(elements(parts, tags), between)
    return F.regexp_replace(let(tokens(html), kept), r"(?s)<!--.*?-->", " ")


def elements_text(html: Column, tag: str) -> Column:
    """The outermost elements of a name, each as its markup."""
    return let(tokens(html), lambda parts: F.transform(elements(parts, (tag,)), lambda c: F.array_join(F.slice(parts, c["a"], c["b"] - c["a"] + 1), "")))


def html_text(html: Column, cap: int | None = None) -> Column:
    """Visible text: scripts and page furniture dropped, tags and entities gone; whole unless ``cap`` is given."""
    bare = F.regexp_replace(drop_elements(html, vocab.DROPPED_TAGS), r"(?s)<[^>]+>", " ")
    whole = squash(unescape(bare))
    return whole if cap is None else F.left(whole, F.lit(cap))


def absolute_url(base: Column, href: Column) -> Column:
    """A link of a page as an absolute url without fragment.

    Null when it has another scheme; dot segments are kept as written.
    """
    link = F.substring_index(href, "#", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    origin = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    folder = F.when(F.rlike(page, F.lit(r"^[^:]+://[^/]*/")), F.regexp_replace(page, r"[^/]*$", "")) \
        .otherwise(F.concat(origin, F.lit("/")))
    return (F.when(F.rlike(link, F.lit(r"^(?i)https?://")), link)
            .when(F.startswith(link, F.lit("//")), F.concat(F.substring_index(base, ":", 1), F.lit(":"), link))
            .when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), F.lit(None))
            .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
            .when(link == "", page)
            .otherwise(F.concat(folder, link)))


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute url without port and leading ``www.``."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def looks_blocked(text: Column, title: Column) -> Column:
    """Block page or soft 404 served with a success status."""
    head = F.lower(F.left(F.coalesce(text, F.lit("")), F.lit(600)))
    probe = F.concat(F.lower(F.coalesce(title, F.lit(""))), F.lit(" "), F.left(head, F.lit(180)))
    return contains_any(head, vocab.BLOCK_MARKERS) | contains_any(probe, vocab.NOTFOUND_MARKERS)


def page_status(text: Column, title: Column, floor: int = vocab.MIN_TEXT) -> Column:
    """BLOCKED, NOT_FOUND, STUB or OK, in that order."""
    head = F.lower(F.left(F.coalesce(text, F.lit("")), F.lit(600)))
    probe = F.concat(F.lower(F.coalesce(title, F.lit(""))), F.lit(" "), F.left(head, F.lit(180)))
    return (F.when(contains_any(head, vocab.BLOCK_MARKERS), "BLOCKED")
            .when(contains_any(probe, vocab.NOTFOUND_MARKERS), "NOT_FOUND")
            .when(F.length(F.coalesce(text, F.lit(""))) < floor, "STUB")
            .otherwise("OK"))


def is_listed_with_region(quote: Column) -> Column:
    """The nation is named as one item of a regional list.

    A pair counts when only a list connector of at most 28 characters stands
    between the national and the regional term, on either side.
    """
    def near(first: str, second: str) -> Column:
        # A lookahead holds the far term, so one term may close one pair and
        # open the next; the captured gap is then measured.
        gaps = F.regexp_extract_all(quote, F.lit(
            rf"(?i)(?:{first})({vocab.LIST_CONNECTOR})(?={second})"), F.lit(1))
        return F.exists(gaps, lambda g: F.length(g) <= vocab.LIST_WINDOW)
    return near(vocab.NATIONAL_TERMS, vocab.REGION_TERMS) | near(vocab.REGION_TERMS, vocab.NATIONAL_TERMS)


def env_layer(quote: Column, proposed: Column) -> Column:
    """``struct(layer, changed, reason)``: the layer a quote supports.

    Downgrades a national proposal to REGIONAL unless the quote names the nation
    outside a regional list; never upgrades.
    """
    quote = F.coalesce(quote, F.lit(""))
    wanted = F.upper(F.when(F.coalesce(proposed, F.lit("")) == "", "GLOBAL").otherwise(proposed))
    found = F.struct(F.rlike(quote, F.lit("(?i)" + vocab.NATIONAL_TERMS)).alias("national"),
                     is_listed_with_region(quote).alias("listed"),
                     F.rlike(quote, F.lit("(?i)" + vocab.REGION_TERMS)).alias("regional"))
    reason = let(found, lambda f: F.when(f["national"] & ~f["listed"], "")
                 .when(f["listed"], "UAE named only within a regional list")
                 .when(f["regional"], "quote names a region, not the UAE")
                 .otherwise("quote does not name the UAE or an Emirate"))
    reason = F.when(wanted != "UAE", "").otherwise(reason)
    return let(reason, lambda r: F.struct(
        F.when(r != "", "REGIONAL").otherwise(wanted).alias("layer"),
        (r != "").alias("changed"), r.alias("reason")))


def platitude(text: Column) -> Column:
    """Why a statement is not a finding, or the empty string when it is one."""
    discriminates = F.rlike(text, F.lit(vocab.DISCRIMINATING)) | F.rlike(text, F.lit(vocab.MUST_BE))
    return (F.when(F.rlike(text, F.lit(vocab.BOOSTER)),
                   "asserts that something is important rather than what is true")
            .when(F.rlike(text, F.lit(vocab.VAGUE_IMPERATIVE)),
                  "is a generic recommendation, not an analytical conclusion")
            .when(~discriminates,
                  "makes no discriminating claim — it does not say X rather than Y, "
                  "X causes Y, or X is actually Z")
            .otherwise(""))


def has_placeholder(text: Column) -> Column:
    """An unfilled slot such as [Year], <date>, {n} or TBD; ids are not slots."""
    return F.rlike(F.coalesce(text, F.lit("")), F.lit(vocab.PLACEHOLDER))


def is_observable(threshold: Column) -> Column:
    """A threshold somebody could see being crossed."""
    t = strip(F.coalesce(threshold, F.lit("")))
    return ((t != "") & ~F.rlike(t, F.lit(vocab.VAGUE_THRESHOLD))
            & F.rlike(t, F.lit(vocab.OBSERVABLE)))


def is_usable_threshold(threshold: Column) -> Column:
    """The reader-side test: anything but blank, TBD, N/A or a dash."""
    t = F.upper(strip(F.coalesce(threshold, F.lit(""))))
    return ~t.isin("", "TBD", "N/A", "-")


def figure_admission(kind: Column, caption: Column, alt: Column) -> Column:
    """``struct(admit, near_miss, reason)`` for a proposed figure."""
    kind = F.upper(F.coalesce(kind, F.lit("")))
    caption = strip(F.coalesce(caption, F.lit("")))
    alt = strip(F.coalesce(alt, F.lit("")))
    informative = kind.isin(*vocab.INFORMATIVE_KINDS)
    artwork = F.rlike(caption, F.lit(vocab.ARTWORK)) | F.rlike(alt, F.lit(vocab.ARTWORK))
    numbered = F.rlike(caption, F.lit(vocab.NUMBERED_CAPTION))
    described = F.length(alt) >= vocab.MIN_ALT_FOR_INTENT
    admit = informative & ~artwork & ((caption != "") | described)
    reason = (F.when(~informative, F.concat(
                  F.lit("kind "), F.when(kind == "", "UNKNOWN").otherwise(kind),
                  F.lit(" is decoration, not information")))
              .when(artwork, "described as artwork by the publisher")
              .when(numbered, "publisher numbered it as a figure")
              .when(caption != "", "carries a publisher caption")
              .when(described, "substantive alt text, no caption")
              .otherwise(F.concat(F.lit("no caption and only "), F.length(alt).cast("string"),
                                  F.lit(" chars of alt text — cannot tell what it shows"))))
    return F.struct(admit.alias("admit"), (informative & ~admit).alias("near_miss"),
                    reason.alias("reason"))


def slug(name: Column, n: int = 28) -> Column:
    """Upper-case key of a name; runs of other characters become one hyphen."""
    key = F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "[^A-Z0-9]+", "-")
    key = F.left(F.regexp_replace(key, "^-+|-+$", ""), F.lit(n))
    return F.when(key == "", "X").otherwise(key)


def search_query(question: Column, max_terms: int = 4) -> Column:
    """The few most distinctive words of a question as a news-index query."""
    words = F.regexp_extract_all(F.lower(question), F.lit("[a-z][a-z0-9-]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in vocab.QUESTION_STOPWORDS])
    terms = F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))
    pairs = [F.lit(x) for kv in vocab.QUERY_ALIASES.items() for x in kv]
    alias = F.create_map(*pairs)
    quoted = lambda w: F.when(F.contains(w, F.lit("-")), F.concat(F.lit('"'), w, F.lit('"'))).otherwise(w)
    parts = F.transform(F.slice(terms, 1, max_terms),
                        lambda w: F.coalesce(F.element_at(alias, w), quoted(w)))
    return F.array_join(parts, " ")


def ask_terms(question: Column, limit: int = 6) -> Column:
    """Up to six content words of a reader's question (duplicates kept)."""
    stop = F.array(*[F.lit(w) for w in vocab.ASK_STOPWORDS])
    words = F.regexp_extract_all(F.lower(question), F.lit("[a-z]{3,}"), F.lit(0))
    return F.slice(F.filter(words, lambda w: ~F.array_contains(stop, w)), 1, limit)


def compact_date(value: Column) -> Column:
    """``20260915T120000Z`` to a date."""
    return F.try_to_timestamp(F.left(value, F.lit(8)), F.lit("yyyyMMdd")).cast("date")


def lead_snippet(text: Column, cap: int = 220) -> Column:
    """Opening of a section without brackets, cut on a word boundary."""
    plain = F.regexp_replace(text, r"\[[^\]]*\]", "")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), r"\s+([.,;:])", "$1"))
    cut = F.concat(F.regexp_replace(F.left(plain, F.lit(cap)), r"\s\S*$", ""), F.lit("…"))
    return F.when(F.length(plain) > cap, cut).otherwise(plain)


def merge_counts(old: Column, new: Column) -> Column:
    """Two count maps as one; the newer value of a shared key wins."""
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def first_mention(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row per key by ``order``: a combined ``min_by``, not a window."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")
