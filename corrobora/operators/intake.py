"""Intake: pages to documents, publishers by domain, and validated evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corrobora import vocab
from corrobora.functions import text


def page_documents(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` to title, visible text, host and verdict."""
    out = pages.withColumn("title", text.html_title(F.col("html"), F.col("url"))) \
        .withColumn("text", text.html_text(F.col("html")))
    return out.select("page_id", "url", "title", "text", text.host_of(F.col("url")).alias("host"),
                      text.page_status(F.col("text"), F.col("title")).alias("status"))


def long_enough(documents: DataFrame, column: str = "text", floor: int = vocab.MIN_TEXT) -> DataFrame:
    """Documents whose text reaches the floor."""
    return documents.where(F.length(F.coalesce(column, F.lit(""))) >= floor)


def feed_documents(items: DataFrame) -> DataFrame:
    """Feed items joined with their page, with the text that is kept.

    ``items(link, item_title, summary, page_title, page_text)``; ``page_text`` is
    null when the page could not be read.  The page's own text is used unless it
    is missing, blocked or short and the feed has a summary, which has a lower
    floor.  A blocked page without a summary still meets the ordinary floor.
    """
    got = F.col("page_text").isNotNull()
    blocked = text.looks_blocked(F.col("page_text"), F.col("page_title"))
    poor = ~got | blocked | (F.length("page_text") < vocab.MIN_TEXT)
    summary = F.coalesce(text.squash(text.unescape(F.regexp_replace("summary", "<[^>]+>", " "))), F.lit(""))
    use_summary = poor & (summary != "")
    title = F.coalesce("item_title", F.lit(""))
    body = F.when(use_summary, F.concat(title, F.lit(". "), summary)).otherwise(F.col("page_text"))
    floor = F.when(use_summary, vocab.SUMMARY_FLOOR).otherwise(vocab.MIN_TEXT)
    reason = (F.when(~use_summary, "page").when(~got, "unreachable").when(blocked, "blocked").otherwise("stub page"))
    out = items.select("link", F.coalesce("item_title", "page_title", "link").alias("title"),
                       body.alias("text"), reason.alias("origin"), floor.alias("floor"))
    return out.where(F.length(F.coalesce("text", F.lit(""))) >= F.col("floor")).drop("floor")


def child_links(pages: DataFrame, keywords=vocab.LINK_KEYWORDS, limit: int | None = None) -> DataFrame:
    """Distinct same-site links, the first ``limit`` or all, per page that look like documents.

    All of it is array work inside the page row: nothing is shuffled.
    """
    root = text.host_of(F.col("url"))
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"), F.lit(0))

    def parse(a: Column) -> Column:
        href = F.regexp_extract(a, r"(?is)^<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']", 1)
        label = text.unescape(F.regexp_replace(a, "(?s)<[^>]+>", " "))
        return F.struct(text.absolute_url(F.col("url"), text.unescape(href)).alias("link"), label.alias("label"))

    def keep(a: Column) -> Column:
        blob = F.lower(F.concat(a["link"], F.lit(" "), a["label"]))
        wanted = F.endswith(F.lower(a["link"]), F.lit(".pdf")) | text.contains_any(blob, keywords)
        return F.coalesce(F.startswith(a["link"], F.lit("http")) & (text.host_of(a["link"]) == root) & wanted,
                          F.lit(False))

    links = F.array_distinct(F.transform(F.filter(F.transform(anchors, parse), keep), lambda a: a["link"]))
    return pages.select("page_id", F.posexplode(links if limit is None else F.slice(links, 1, limit)).alias("pos", "link"))


def figure_candidates(pages: DataFrame) -> DataFrame:
    """Images of a page that could carry information, each url once, in page order.

    Captioned figures come first, then plain images, then the social-card image.
    Row-local: arrays of structs, no shuffle.
    """
    attr = lambda tag, name: text.unescape(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1))
    size = lambda tag, name: F.try_to_number(
        F.nullif(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*[\"']?\s*(\d{{1,9}})(?:px)?\s*[\"'\s/>]", 1), F.lit("")),
        F.lit("999999999")).cast("int")

    def largest(srcset: Column) -> Column:
        parts = F.filter(F.transform(F.split(srcset, ","), text.strip), lambda p: p != "")
        sized = F.transform(parts, lambda p, i: F.struct(
            F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(p, r"\s(\d{1,9})w$", 1), F.lit("")),
                                       F.lit("999999999")).cast("int"), F.lit(0)).alias("w"),
            (-i).alias("first"), F.regexp_extract(p, r"^(\S+)", 1).alias("u")))
        return F.array_max(sized)["u"]

    def image(tag: Column, caption: Column) -> Column:
        src = attr(tag, "src")
        return F.struct(F.when(src != "", src).otherwise(largest(attr(tag, "srcset"))).alias("src"),
                        text.strip(attr(tag, "alt")).alias("alt"),
                        caption.alias("caption"),
                        size(tag, "width").alias("width"), size(tag, "height").alias("height"))

    null_int = F.lit(None).cast("int")

    def images_of(html: Column) -> Column:
        with_img = F.filter(text.elements_text(html, "figure"), lambda f: F.rlike(f, F.lit(r"(?i)<img\s")))
        captioned = F.transform(with_img, lambda f: image(
            F.regexp_extract(f, r"(?is)<img\s[^>]*>", 0),
            text.squash(text.unescape(F.regexp_replace(
                F.regexp_extract(f, r"(?is)<figcaption\b[^>]*>(.*?)</figcaption>", 1), "(?s)<[^>]+>", " ")))))
        images = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<img\s[^>]*>"), F.lit(0)),
                             lambda t: image(t, F.lit("")))
        metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0)),
                         lambda m: F.rlike(m, F.lit(r"(?i)(property|name)\s*=\s*[\"'](og|twitter):image[\"']")))
        cards = F.transform(metas, lambda m: F.struct(
            attr(m, "content").alias("src"), F.lit("social card image").alias("alt"), F.lit("").alias("caption"),
            null_int.alias("width"), null_int.alias("height")))
        return F.transform(F.concat(captioned, images, cards), lambda c: F.struct(
            F.when((c["src"] != "") & ~F.startswith(c["src"], F.lit("data:")),
                   text.absolute_url(F.col("url"), c["src"])).alias("image_url"),
            c["alt"].alias("alt"), c["caption"].alias("caption"), c["width"].alias("width"), c["height"].alias("height")))

    def first_of_each(kept: Column) -> Column:
        return text.let(F.transform(kept, lambda c: c["image_url"]), lambda urls: F.filter(
            kept, lambda c, i: F.array_position(urls, c["image_url"]) == i + 1))

    big = lambda n: n.isNull() | (n >= vocab.MIN_IMAGE_EDGE) | (n == 0)
    # The furniture is dropped once a page, and its images are found once, not once an image.
    found = text.let(text.drop_elements(F.col("html"), ("nav", "footer", "header", "aside", "script", "style")), images_of)
    kept = F.filter(found, lambda c: F.coalesce(
        F.startswith(c["image_url"], F.lit("http")) & ~F.rlike(c["image_url"], F.lit(vocab.JUNK_IMAGE))
        & big(c["width"]) & big(c["height"]), F.lit(False)))
    return pages.select("page_id", F.posexplode(text.let(kept, first_of_each)).alias("pos", "c")).select("page_id", "pos", "c.*")


def map_domains(urls: DataFrame, domains: DataFrame, fallback, ignore=()) -> DataFrame:
    """The publisher of each url: the most specific registered domain of its host.

    ``urls(url_id, url)``, ``domains(domain, registry_id, pos)``.  Instead of a
    suffix theta join, the host's label suffixes are exploded and joined by
    equality; the longest wins, equal lengths go to the domain listed first.
    Distinct hosts are resolved once: a site with a third of all urls costs one
    lookup, and its urls join back by host.
    """
    hosted = urls.withColumn("host", text.host_of(F.col("url")))
    hosts = hosted.where("host <> ''").select("host").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    listed = domains.where((F.col("domain") != "") & ~F.col("domain").isin(*ignore)) if ignore else domains.where("domain <> ''")
    first = listed.groupBy("domain").agg(F.min_by("registry_id", "pos").alias("registry_id"))
    best = (hosts.select("host", F.explode(suffixes).alias("domain")).join(first, "domain")
            .groupBy("host").agg(F.max_by("registry_id", F.length("domain")).alias("registry_id")))
    out = hosted.join(best, "host", "left")
    return (out.withColumn("matched", F.col("registry_id").isNotNull())
            .withColumn("registry_id", F.coalesce("registry_id", F.lit(fallback))))


def bound_sources(registry: DataFrame, topic_sources: DataFrame, topics: DataFrame) -> DataFrame:
    """Sources bound to a live topic of ``topics`` (filter it to scope the answer)."""
    live = topics.where(~F.col("retired")).select("topic_id")
    bound = topic_sources.join(live, "topic_id", "left_semi")
    return registry.join(bound.select("registry_id"), "registry_id", "left_semi")


def unread_documents(documents: DataFrame, sources: DataFrame, read_log: DataFrame,
                     limit: int | None = None) -> DataFrame:
    """Documents of the given sources that the consumer's read log lacks, newest first."""
    out = (documents.join(sources.select("registry_id"), "registry_id", "left_semi")
           .join(read_log.select("document_id"), "document_id", "left_anti"))
    return out if limit is None else out.orderBy(F.desc("retrieved_on"), "document_id").limit(limit)


def documents_behind(documents: DataFrame, evidence_sources: DataFrame, live_evidence: DataFrame) -> DataFrame:
    """Documents that carry live evidence: two semi-joins."""
    used = evidence_sources.join(live_evidence.select("evidence_id"), "evidence_id", "left_semi")
    return documents.join(used.select("document_id"), "document_id", "left_semi")


def validate_evidence(candidates: DataFrame, documents: DataFrame, topics: DataFrame) -> DataFrame:
    """First rule each evidence candidate breaks, null when it is valid.

    ``candidates(candidate_id, doc_id, pillar, reader_pillar, topic_id, claim,
    quote, hook)``; ``documents(doc_id, text)``.  Each document is reduced to its
    letters once, below the join.
    """
    live = topics.where(~F.col("retired")).select(F.col("topic_id"), F.col("pillar").alias("topic_pillar"))
    whole = documents.select("doc_id", text.letters(F.col("text")).alias("whole"))
    out = (candidates.withColumn("quote_letters", text.letters(F.col("quote")))
           .withColumn("hook_letters", text.letters(F.col("hook")))
           .join(live, "topic_id", "left").join(whole, "doc_id", "left"))
    outside = lambda c, lo, hi: ~F.length(F.coalesce(c, F.lit(""))).between(lo, hi)
    schema = outside(F.col("claim"), 20, 500) | outside(F.col("quote"), 10, 400) | outside(F.col("hook"), 0, 200)
    topical = (F.col("pillar") == F.col("reader_pillar")) & (F.col("topic_pillar") == F.col("reader_pillar"))
    reason = (F.when(schema, "schema")
              .when(~F.coalesce(topical, F.lit(False)), "pillar_topic")
              .when(~F.coalesce(text.within(F.col("quote_letters"), F.col("whole")), F.lit(False)), "quote_not_in_document")
              .when(~text.within(F.col("hook_letters"), F.col("quote_letters")), "no_hook_in_quote"))
    return out.withColumn("reason", reason).drop("quote_letters", "hook_letters", "whole", "topic_pillar")


def entity_violations(entities: DataFrame, reader_pillar: Column) -> DataFrame:
    """Entities of another pillar, or of a type outside their pillar's catalogue."""
    allowed = F.lit(False)
    for pillar, types in vocab.ENTITY_TYPES.items():
        allowed = allowed | ((F.col("pillar") == pillar) & F.col("entity_type").isin(*types))
    return entities.where((F.col("pillar") != reader_pillar) | ~allowed)


def topic_violations(topics: DataFrame, core_pillar: str) -> DataFrame:
    """(topic_id, problem) of live topics that lack a function, an impact or a name."""
    live = topics.where(~F.col("retired"))
    blank = F.trim(F.coalesce("impact", F.lit(""))) == ""
    problems = F.array_compact(F.array(
        F.when(F.size(F.coalesce("functions", F.array().cast("array<string>"))) == 0, "no_function"),
        F.when((F.col("pillar") != core_pillar) & blank, "no_impact"),
        F.when(F.length(F.trim("name")) < 4, "short_name")))
    return live.select("topic_id", F.explode(problems).alias("problem"))


def array_key_violations(rows: DataFrame, key: str, column: str, catalogue: DataFrame) -> DataFrame:
    """(key, value) of array elements that the catalogue's first column lacks."""
    name = catalogue.columns[0]
    return (rows.select(key, F.explode(column).alias("value")).distinct()
            .join(catalogue.select(F.col(name).alias("value")), "value", "left_anti"))


def topic_home(topics: DataFrame, lens: DataFrame, functions: DataFrame) -> DataFrame:
    """Home branch of new topics: the passed one, else the pillar's lens, else the
    parent of the first function.

    ``topics(topic_id, pillar, branch_id, functions)``, ``lens(pillar, lens_id)``,
    ``functions(node_id, parent_id)``.
    """
    first = F.try_element_at("functions", F.lit(1))
    return (topics.withColumn("node_id", first).join(lens, "pillar", "left")
            .join(functions.select("node_id", "parent_id"), "node_id", "left")
            .select("topic_id", F.coalesce("branch_id", "lens_id", "parent_id").alias("home_id")))


def ask(evidence: DataFrame, question: str, n: int = 6) -> DataFrame:
    """Evidence whose claim holds any content word of the question, by id.

    The words come out of the question as a literal expression; a question
    without content words returns the first rows.
    """
    terms = text.ask_terms(F.lit(question))
    low = F.lower("claim")
    hit = F.exists(terms, lambda k: F.contains(low, k)) | (F.size(terms) == 0)
    return evidence.where(hit).orderBy("evidence_id").limit(n)


def showcase(evidence: DataFrame, n: int = 1) -> DataFrame:
    """The row shown first: newest class-A row of medium quote length whose claim
    is a paraphrase, else simply the newest class-A row."""
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " ")
    fits = F.length("quote").between(90, 240) & (plain("claim") != plain("quote"))
    return (evidence.where(F.col("class") == "A").withColumn("fits", F.coalesce(fits, F.lit(False)))
            .orderBy(F.desc("fits"), F.desc("created_on"), F.desc("evidence_id")).limit(n))


def backfill_read_pillars(evidence: DataFrame, evidence_sources: DataFrame) -> DataFrame:
    """Pillars that already produced evidence from each document (a small domain)."""
    return (evidence_sources.join(evidence.select("evidence_id", "pillar"), "evidence_id")
            .groupBy("document_id").agg(F.array_sort(F.collect_set("pillar")).alias("pillars")))


def repoint_topics(evidence: DataFrame, mapping: DataFrame) -> DataFrame:
    """Old topics replaced by their successor; unmatched rows stay."""
    new = mapping.select(F.col("old_topic").alias("topic_id"), "new_topic")
    return (evidence.join(new, "topic_id", "left")
            .withColumn("topic_id", F.coalesce("new_topic", "topic_id")).drop("new_topic"))


def bind_sources(bindings: DataFrame, registry: DataFrame) -> DataFrame:
    """Bindings to sources that are live."""
    return bindings.join(registry.where(~F.col("archived")).select("registry_id"), "registry_id", "left_semi")


def dataset_row(records: DataFrame, matching: Column, name: str, claim: str, sample: int,
                separator: str = "; ", empty: str = "no records") -> DataFrame:
    """One evidence row about a whole dataset: counts in the claim, names as quote.

    The quote holds the first names in sorted order; they are found with a
    top-k, so the names are never collected whole.
    """
    counts = records.agg(F.count("*").alias("active"), F.count_if(matching).alias("matching"))
    top = records.where(matching).select(F.col(name).alias("name")).orderBy("name").limit(sample)
    quote = top.agg(F.array_join(F.array_sort(F.collect_list("name")), separator).alias("quote"))
    return (text.attach(counts, quote)
            .select("active", "matching", F.format_string(claim, F.col("active"), F.col("matching")).alias("claim"),
                    F.when(F.col("quote") == "", empty).otherwise(F.col("quote")).alias("quote")))
