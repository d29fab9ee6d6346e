"""What a line or a token looks like: prose, a heading, a title, an employer, a link, a skill."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedgework.functions import dates as T
from sedgework.functions import text as X
from sedgework.functions import values as V

WORD_START, WORD_END = "(^|[^0-9A-Za-z_])", "($|[^0-9A-Za-z_])"


def has_word(text: Column, words: str) -> Column:
    """Whether one of some words is in a text, in any case, between characters that are no part of words."""
    return text.rlike(f"(?i){WORD_START}(?:{words}){WORD_END}")


def word_count(text: Column) -> Column:
    return F.size(X.tokens(text))


def is_prose(text: Column) -> Column:
    """A running sentence: words of lower case, a sentence break inside, eight words or more."""
    t = F.trim(text)
    return t.rlike("[a-z]") & t.rlike(V.SENTENCE_BREAK) & (word_count(t) >= V.PROSE_WORDS)


def is_entry_header(text: Column) -> Column:
    """Reads like the head of an entry: capital or digit first, and no date alone, prose or note."""
    t = F.trim(text)
    return t.rlike("^[A-Z0-9]") & ~T.is_date_only(t) & ~is_prose(t) & ~t.rlike(V.PROGRAM_NOTE)


def is_middot_metadata(text: Column) -> Column:
    """A grade code, then more, set apart by middle dots."""
    parts = F.filter(F.split(F.trim(text), "\\s*\u00b7\\s*"), lambda p: p != "")
    return (F.size(parts) >= 2) & F.coalesce(F.get(parts, 0).rlike(V.GRADE_CODE), F.lit(False))


def is_verb_led_scope(text: Column) -> Column:
    """An action verb first, and later a word of lower case that is no connective."""
    words = F.split(F.trim(text), "\\s+")
    bare = F.transform(F.slice(words, 2, 10_000), lambda w: F.regexp_replace(w, "^[^\\p{L}]+|[^\\p{L}]+$", ""))
    return X.starts_with_verb(text) & F.exists(bare, lambda w: w.rlike("^\\p{Ll}[\\p{Ll}\\p{M}'\u2019-]*$") & ~w.isin(*V.CONNECTORS))


def is_scope_prose(text: Column) -> Column:
    """A line under a date that is text, not part of the head: a semicolon, a grade line, a verb's scope, or a sentence's end."""
    t = F.trim(text)
    return (t != "") & (t.contains(";") | is_middot_metadata(t) | is_verb_led_scope(t) | (t.rlike("[.!?]$") & ~t.rlike(V.LEGAL_END)))


def is_page_furniture(text: Column) -> Column:
    return text.rlike(V.FURNITURE) | text.rlike(V.LONE_CV)


def looks_like_title(text: Column) -> Column:
    return ~has_word(text, V.COMPANY_WORDS) & has_word(text, V.TITLE_WORDS)


def looks_like_company(text: Column) -> Column:
    return (has_word(text, V.COMPANY_WORDS) | has_word(text, V.SCHOOL_WORDS)) & ~looks_like_title(text)


def _header_form(t: Column) -> Column:
    return F.length(t).between(1, V.HEADER_CHARS) & ~t.rlike(V.HEADER_BULLET) & ~t.rlike("[.!?]$")


def is_capital_header(text: Column) -> Column:
    """Two to six words of capitals without digits and marks."""
    t = F.trim(text)
    capitals = T.let(F.regexp_replace(t, "[^A-Za-z]", ""), lambda x: (x != "") & (x == F.upper(x)))
    return _header_form(t) & ~t.rlike(V.HEADER_DIRT) & capitals & word_count(t).between(2, V.CAPITAL_WORDS)


def is_visual_header(text: Column, font: Column, body_font: Column) -> Column:
    """A short line in a larger font than the body's, or of capitals."""
    t = F.trim(text)
    return (_header_form(t) & (word_count(t) <= V.HEADER_WORDS) & (font >= body_font * V.HEADER_FONT)) | is_capital_header(text)


def has_contact(text: Column) -> Column:
    return text.rlike(V.EMAIL) | text.rlike(f"{V.PHONE}{WORD_END}") | text.rlike(V.LINKEDIN_PROFILE)


def is_linkedin_profile(url: Column) -> Column:
    return url.rlike("(?i)linkedin[.]com/[A-Za-z0-9]") & ~url.rlike(V.LINKEDIN_OTHER)


def has_scheme(url: Column) -> Column:
    return url.rlike("(?i)^(https?://|www[.])")


def is_website(url: Column) -> Column:
    """With a scheme or www, or of a common top-level domain."""
    host = F.element_at(F.split(F.lower(url), "/"), 1)
    return has_scheme(url) | F.element_at(F.split(host, "[.]"), -1).isin(*V.WEBSITE_TLDS)


def is_standalone_url(url: Column, text: Column) -> Column:
    """Not inside of a sentence: no word before and after it at once."""
    at = F.instr(text, url)
    before, after = F.rtrim(F.substring(text, F.lit(1), at - 1)), F.ltrim(F.substring(text, at + F.length(url), F.length(text)))
    return has_scheme(url) | (at == 0) | ~(before.rlike("[0-9A-Za-z_]$") & after.rlike("^[0-9A-Za-z_]"))


def full_url(raw: Column) -> Column:
    """With https where no scheme is, without www and marks at the end; null if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.trim(raw), "[,;.)/]+$", ""), "(?i)^(https?://)?www[.]", "$1")
    whole = lambda t: F.when((t != "") & ~t.rlike("(?i)^[a-z][a-z0-9+.-]*:$"), F.when(t.rlike("(?i)^[a-z][a-z0-9+.-]*://"), t).otherwise(F.concat(F.lit("https://"), t)))
    return T.let(t, whole)


def shown_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(url), "(?i)^https?://", ""), "(?i)^www[.]", ""), "/+$", "")


def is_skill_token(token: Column) -> Column:
    """Two to forty characters and at most six words; no number, link or range of years; some letters alone."""
    link = token.rlike("(?i)(linkedin|github)")
    return F.lower(token).isin(*V.LONE_LETTERS) | (F.length(token).between(2, 40) & ~token.rlike("^[0-9]+$") & ~link & ~token.rlike(V.SKILL_RANGE) & (F.size(F.split(token, "\\s+")) <= 6))


def email_complaint(value: Column) -> Column:
    return F.when((F.trim(value) != "") & ~F.trim(value).rlike(V.EMAIL_FIELD), V.EMAIL_MESSAGE)


def url_complaint(value: Column) -> Column:
    return F.when((F.trim(value) != "") & ~F.trim(value).rlike(V.URL_FIELD), V.URL_MESSAGE)


def title_key(text: Column) -> Column:
    """A line's key without brackets, year and separators at its end."""
    out = X.bullet_key(text)
    for pattern in ("\\s*\\[[^\\]]*\\]\\s*$", "[\\s,;\u00b7|\u2013\u2014-]*((19|20)[0-9]{2})\\s*$", "[\\s,;\u00b7|\u2013\u2014-]+$"):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(out)


def without_label(key: Column) -> Column:
    """A key without a leading short label before a middle dot; null if it has none."""
    at = F.instr(key, " \u00b7 ")
    label = F.trim(F.substring(key, F.lit(1), at - 1))
    rest = F.trim(F.substring(key, at + 3, F.length(key)))
    return F.when((at > 0) & (label != "") & (F.length(label) <= V.ACHIEVEMENT_TYPE_CHARS) & (rest != ""), rest)


def owned_by_title(line: Column, title: Column) -> Column:
    """Whether an entry's title says what a line says, but for a label, a year and separators."""
    owned, key = title_key(F.coalesce(title, F.lit(""))), title_key(line)
    return (owned != "") & ((key == owned) | F.coalesce(without_label(key) == owned, F.lit(False)))


def role_label(title: Column, company: Column) -> Column:
    named = F.concat_ws(" \u2014 ", T.some(title), T.some(company))
    return F.when(named != "", named).otherwise("Untitled role")


def role_header(title: Column, company: Column, start: Column, end: Column, current: Column) -> Column:
    """Title, company and dates of a role on one line."""
    named = F.concat_ws(" \u2014 ", T.some(title), T.some(company))
    dates = T.shown_range(start, end, current, "\u2013")
    return F.concat_ws(" \u00b7 ", F.when(named != "", named), F.when(dates != "", dates))


def header_keys(title: Column, company: Column, place: Column, team: Column) -> Column:
    """All keys of a role's head: both orders of title and company, with and without place and team."""
    t, c, p, m = (T.some(x) for x in (title, company, place, team))
    tails = (F.lit(None).cast("string"), p, m, F.concat_ws(" ", p, m))
    keys = F.array(*[X.flat(F.concat_ws(" ", a, b, tail)) for tail in tails for a, b in ((t, c), (c, t))])
    return F.when(t.isNotNull() & c.isNotNull(), F.array_distinct(keys)).otherwise(F.array().cast("array<string>"))


def is_bare_place(text: Column) -> Column:
    """Nothing but a place: a state's code, a known city, or a city with a state or a country."""
    tail = F.regexp_extract(text, f"^{V.PLACE_WORDS},\\s*(.+)$", 1)
    whole = text.rlike(f"^{V.PLACE_WORDS},\\s*(?:[A-Z]{{2}}|{V.PLACE_WORDS})$")
    return text.isin(*V.STATE_CODES) | text.rlike(f"(?i)^(?:{V.CITIES})$") | (whole & (tail.isin(*V.STATE_CODES) | F.lower(tail).isin(*V.COUNTRIES)))
