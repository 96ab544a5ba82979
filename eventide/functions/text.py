"""Text functions as column expressions. White space and words follow Unicode ((?U))."""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (
    ACTIONS,
    BRIDGE_PATTERN,
    DATE_PATTERN,
    ENTITY_MARKERS,
    EPISODE_PATTERN,
    EVENT_TYPES,
    GENERIC_KEYWORDS,
    MODEL_PATTERN,
    MODEL_YEAR_PATTERN,
    NOT_PLACES,
    PLACE_PATTERN,
    QUESTION_SHELLS,
    TEMPLATE_PHRASES,
    TERM_EDGES,
    TITLE_ACTIONS,
    TITLE_HAZARDS,
    TOKEN_BREAKS,
)
from .settle import let

CJK = r"\x{4e00}-\x{9fff}"
_NONE = "array<string>"
_LINK = r"(?i)https?://\S+|www\.\S+"


def empty() -> Column:
    return F.array().cast(_NONE)


def unescape_html(c: Column) -> Column:
    """Every named and numeric character reference as its character. Only texts with an ampersand
    go through Python, in Arrow batches; the names are those of Python's own table."""

    @F.pandas_udf("string")
    def mend(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: html.unescape(t) if t is not None else None)

    return F.coalesce(mend(F.when(F.contains(c, F.lit("&")), c)), c)


def strip_html(c: Column) -> Column:
    """Character references become characters, then tags become spaces."""
    return F.replace(F.regexp_replace(unescape_html(c), "<[^>]+>", " "), F.lit("\u00a0"), F.lit(" "))


def clean_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(strip_html(c), r"(?U)\s+", " "))


def clean_body(c: Column) -> Column:
    """No links, no template phrases, single spaces in a line, two line feeds in a row at most."""
    c = F.regexp_replace(strip_html(c), _LINK, "")
    for phrase in TEMPLATE_PHRASES:
        c = F.replace(c, F.lit(phrase), F.lit(""))
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), F.lit(" \n"))


def normalize_words(c: Column) -> Column:
    """Lower case without anything but word characters."""
    return F.lower(F.regexp_replace(c, r"(?U)\W+", ""))


def normalize_space(c: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def lexical_tokens(c: Column) -> Column:
    """Runs of CJK as character pairs (a lone character by itself), runs of ASCII letters and
    digits whole; lower case, repeats kept."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(rf"([a-z0-9]+|[{CJK}]+)"), F.lit(1))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    cut = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(rf"^[{CJK}]{{2,}}$"), pairs(r)).otherwise(F.array(r))))
    return F.when(c.rlike(f"[{CJK}]"), cut).otherwise(runs)  # most texts have no pairs to cut


def ngrams(c: Column, low: int, high: int) -> Column:
    """The distinct character n-grams of low to high characters. The text is worked out and cut into
    characters once, so a text's cost grows with its length alone."""

    def of(v: Column) -> Column:
        x = v["chars"]
        one = lambda n: F.when(F.size(x) >= n, F.transform(F.sequence(F.lit(0), F.size(x) - n), lambda i: F.concat(*[F.get(x, i + k) for k in range(n)]))).otherwise(empty())
        return F.array_distinct(F.concat(*[one(n) for n in range(low, high + 1)]))

    return let(of, chars=F.filter(F.split(c, ""), lambda x: x != ""))  # an empty text splits into one empty string


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Shared over the elements of ``a``; 0 if it is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a))).otherwise(0.0)


def term_overlap(terms: Column, text: Column) -> Column:
    """Share of the terms that the text contains."""
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(text, t))) / F.size(terms)).otherwise(0.0)


def title_containment(a: Column, b: Column, least: int = 6) -> Column:
    """Both normalised titles have ``least`` characters and one contains the other."""
    x, y = normalize_words(a), normalize_words(b)
    return (F.length(x) >= least) & (F.length(y) >= least) & (F.contains(x, y) | F.contains(y, x))


def phrases(c: Column) -> Column:
    """Hashtags, then quoted phrases of 2 to 30 characters, in order, once each."""
    tags = F.regexp_extract_all(c, F.lit(r"#([^#\s]+)#?"), F.lit(1))
    quotes = F.regexp_extract_all(c, F.lit(r"[《「『“\"']([^》」』”\"']{2,30})[》」』”\"']"), F.lit(1))
    return F.array_distinct(F.concat(tags, quotes))


def found(c: Column, terms: Sequence[str]) -> Column:
    """The listed terms that a text contains, in the order of the list."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(c, t))


def actions(c: Column, terms: Sequence[str] = ACTIONS) -> Column:
    return found(c, terms)


def event_type(c: Column, rules=EVENT_TYPES) -> Column:
    """The first rule with a word in the text; unknown without."""
    out = F.when(F.lit(False), F.lit(""))
    for name, terms in rules:
        out = out.when(c.rlike("|".join(terms)), F.lit(name))
    return out.otherwise("unknown")


def entities(c: Column, markers: Sequence[str] = ENTITY_MARKERS) -> Column:
    """Quoted phrases, then CJK runs up to and with their first marker, of at most 8 characters
    before it. A leading city sign, one after 上 or 全, and the words for market and citizens
    aren't markers."""
    marker = "|".join(m if m != "市" else r"(?<![上全^])(?<!^)市(?![场民])" for m in markers)
    runs = F.regexp_extract_all(c, F.lit(rf"([{CJK}]+)"), F.lit(1))
    cut = F.transform(runs, lambda r: F.regexp_extract(r, rf"^(.*?(?:{marker}))", 1))
    short = F.transform(F.filter(cut, lambda x: x != ""), lambda x: F.right(x, F.least(F.length(x), F.lit(10))))
    return F.array_distinct(F.concat(phrases(c), short))


def keywords(c: Column, generic: Sequence[str] = GENERIC_KEYWORDS, listed: Sequence[str] = ACTIONS, limit: int = 8) -> Column:
    """Phrases, then tokens between spaces and punctuation, then each CJK run (whole if it has at
    most 8 characters) and its n-grams of 2, 3 and 4; without marks at their ends, generic and
    action terms; the first ``limit``, once each. Null without a text."""
    parts = F.split(c, f"(?U){TOKEN_BREAKS}")
    runs = F.regexp_extract_all(c, F.lit(rf"([{CJK}]{{2,}})"), F.lit(1))
    cut = F.flatten(F.transform(runs, lambda r: F.concat(F.when(F.length(r) <= 8, F.array(r)).otherwise(empty()), ngrams(r, 2, 4))))
    terms = F.transform(F.concat(phrases(c), parts, cut), lambda t: F.btrim(t, F.lit(TERM_EDGES)))
    bad = lambda t: (t == "") | (t.rlike("|".join(generic)) if generic else F.lit(False)) | (t.isin(*listed) if listed else F.lit(False))
    return F.slice(F.array_distinct(F.filter(terms, lambda t: ~bad(t))), 1, limit)


def strip_question(c: Column) -> Column:
    """Without links, hashtag signs, question shells, and repeated punctuation."""
    c = F.regexp_replace(F.regexp_replace(c, _LINK, ""), r"#([^#]+)#", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "|".join(QUESTION_SHELLS), ""), r"([!?！？。.,，、])\1+", "$1"))


def term_edges(term: Column) -> Column:
    """A term without the punctuation and white space at its ends."""
    return F.regexp_replace(term, r"(?U)^[\s\p{Punct}\p{IsPunctuation}]+|[\s\p{Punct}\p{IsPunctuation}]+$", "")


def facts(title: Column) -> Column:
    """What a title states that two titles can disagree on, as a struct of arrays."""
    every = lambda pattern, group=1: F.regexp_extract_all(title, F.lit(pattern), F.lit(group))
    once = F.array_distinct
    says = lambda words: title.rlike("|".join(words))
    parts = F.arrays_zip(*[every(DATE_PATTERN, g).alias(n) for g, n in ((1, "y"), (2, "m"), (3, "d"))])
    two = lambda x: F.lpad(x, 2, "0")
    day = lambda p: F.date_format(F.try_to_timestamp(F.concat_ws("-", p["y"], two(p["m"]), two(p["d"])), F.lit("yyyy-MM-dd")), "yyyy-MM-dd")
    listed = lambda words: F.array_compact(F.array(*[F.when(says(w), F.lit(n)) for n, w in words.items()]))
    found_actions = listed(TITLE_ACTIONS)
    # A notice that is released about something else is about that alone.
    action = F.when(F.size(found_actions) > 1, F.array_remove(found_actions, "release")).otherwise(found_actions)
    return F.struct(
        once(F.array_compact(F.transform(parts, day))).alias("explicit_date"),
        once(F.transform(every(MODEL_PATTERN), lambda m: F.lower(F.replace(m, F.lit("-"), F.lit(""))))).alias("model"),
        once(every(MODEL_YEAR_PATTERN)).alias("model_year"),
        once(every(EPISODE_PATTERN)).alias("episode"),
        once(F.filter(every(PLACE_PATTERN), lambda p: ~p.rlike("|".join(NOT_PLACES)))).alias("location"),
        once(F.transform(every(BRIDGE_PATTERN), lambda b: F.regexp_replace(b, "^.*市", ""))).alias("named_object"),
        action.alias("action"),
        listed(TITLE_HAZARDS).alias("hazard"),
    )


FACTS = ("explicit_date", "model", "model_year", "episode", "location", "named_object", "action", "hazard")


def _fact(a: Column, b: Column, name: str) -> Column:
    """A fact of ``a`` for a comparison with ``b``: objects lose the places that either names."""
    if name != "named_object":
        return a[name]
    bare = lambda v: F.aggregate(F.concat(a["location"], b["location"]), v, lambda acc, p: F.when(F.startswith(acc, p), F.substring(acc, F.length(p) + 1, F.length(acc))).otherwise(acc))
    return F.transform(a[name], bare)


def conflicts(a: Column, b: Column) -> Column:
    """Names of the facts on which two titles disagree: both state one and share none."""
    def clash(n: str) -> Column:
        x, y = _fact(a, b, n), _fact(b, a, n)
        return F.when((F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y), F.lit(f"{n}_conflict"))

    return F.array_compact(F.array(*[clash(n) for n in FACTS]))


def anchors(a: Column, b: Column) -> Column:
    """What two titles both name that points to one event: a model or an object, as kind:value."""
    shared = lambda n: F.transform(F.array_sort(F.array_intersect(_fact(a, b, n), _fact(b, a, n))), lambda v: F.concat(F.lit(f"{n}:"), v))
    return F.concat(shared("model"), shared("named_object"))


def entity_conflict(a: Column, b: Column, suffixes: Sequence[str], a_text: Column | None = None, b_text: Column | None = None) -> Column:
    """Both lists have entities of one kind and share none of them. A kind is a suffix; with the
    texts given, only entities that stand in their text count, and a Latin name that begins both
    texts is a kind too."""
    low = lambda c, text: F.transform(c if text is None else F.filter(c, lambda e: (e != "") & F.contains(F.lower(text), F.lower(e))), F.lower)
    x, y = low(a, a_text), low(b, b_text)
    ending = lambda c, suffix: F.filter(c, lambda e: F.endswith(e, F.lit(suffix)))
    kinds = [(ending(x, suffix), ending(y, suffix)) for suffix in suffixes]
    if a_text is not None and b_text is not None:
        leads = lambda c, text: F.filter(c, lambda e: e.rlike("^[a-z][a-z0-9-]*$") & F.startswith(F.lower(text), F.concat(e, F.lit(" "))))
        kinds.append((leads(x, a_text), leads(y, b_text)))
    out = F.lit(False)
    for p, q in kinds:
        out = out | ((F.size(p) > 0) & (F.size(q) > 0) & ~F.arrays_overlap(p, q))
    return out


def redact(c: Column) -> Column:
    """Secrets in log lines."""
    c = F.regexp_replace(c, r"(?i)(authorization|cookie|token|secret|password|api[_-]?key)(\"?\s*[:=]\s*\"?)[^\s\",;]+", "$1$2***")
    return F.regexp_replace(c, r"(?i)bearer\s+[A-Za-z0-9._-]+", "Bearer ***")


def quotes_verified(quotes: Column, title: Column, body: Column) -> Column:
    """Every quote stands in the title or the body, and there is one at least."""
    text = F.concat_ws("\n", title, body)
    return (F.size(quotes) > 0) & F.forall(quotes, lambda q: (F.length(F.trim(q)) > 0) & F.contains(text, q))


def strip_emoji(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]|\[[^\[\]\s]{1,8}\]", "")


def remap_ids(ids: Column, aliases: Column) -> Column:
    """Identifiers with their real names out of the map ``aliases``; unknown ones stay."""
    return F.transform(ids, lambda x: F.coalesce(F.try_element_at(aliases, x), x))
