"""HTML expressions: cleaning, attributes, tokens and block segments."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafpress.functions.arrays import let

# Inside of a tag: quoted values may hold '>', everything is matched possessively.
_INSIDE = r"""(?:"[^"]*+"|'[^']*+'|[^'">]++)*+"""

# The character references met most, looked up first.  Blanks of fixed
# width become plain ones, and soft hyphens go.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•", "hellip": "…",
    "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "sbquo": "‚",
    "ldquo": "“", "rdquo": "”", "bdquo": "„", "laquo": "«", "raquo": "»",
    "lsaquo": "‹", "rsaquo": "›", "euro": "€", "pound": "£", "cent": "¢", "yen": "¥",
    "sect": "§", "para": "¶", "deg": "°", "plusmn": "±", "times": "×", "divide": "÷",
    "frac12": "½", "frac14": "¼", "frac34": "¾", "sup2": "²", "sup3": "³", "micro": "µ",
    "larr": "←", "rarr": "→", "uarr": "↑", "darr": "↓", "minus": "−", "infin": "∞",
    "ne": "≠", "le": "≤", "ge": "≥", "iexcl": "¡", "iquest": "¿", "szlig": "ß",
    "agrave": "à", "aacute": "á", "acirc": "â", "atilde": "ã", "auml": "ä", "aring": "å",
    "aelig": "æ", "ccedil": "ç", "egrave": "è", "eacute": "é", "ecirc": "ê", "euml": "ë",
    "igrave": "ì", "iacute": "í", "icirc": "î", "iuml": "ï", "ntilde": "ñ", "ograve": "ò",
    "oacute": "ó", "ocirc": "ô", "otilde": "õ", "ouml": "ö", "oslash": "ø", "ugrave": "ù",
    "uacute": "ú", "ucirc": "û", "uuml": "ü", "Agrave": "À", "Aacute": "Á", "Auml": "Ä",
    "Ccedil": "Ç", "Egrave": "È", "Eacute": "É", "Ntilde": "Ñ", "Oacute": "Ó", "Ouml": "Ö",
    "Uuml": "Ü", "oelig": "œ", "OElig": "Œ", "ensp": " ", "emsp": " ", "thinsp": " ", "shy": "",
}

#: All references of HTML5, with the semicolon where they need one, and those that may go without.
_EVERY = {name: ENTITIES.get(name.rstrip(";"), char) for name, char in html.entities.html5.items()}
_OPEN_ENDED = "|".join(sorted((n for n in _EVERY if not n.endswith(";")), key=lambda n: (-len(n), n)))


def _windows_1252(byte: int) -> str:
    try:
        return bytes([byte]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(byte)


#: Numbers that pages use for the characters of the old Windows code page.
_RENUMBERED = {n: ord(_windows_1252(n)) for n in range(0x80, 0xA0)}

# Tags that start or end a block of text.
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table",
    "tbody", "tfoot", "thead", "tr", "ul",
)


def tag_pattern(names: str) -> str:
    """Pattern of an opening tag; ``names`` is an alternation of tag names."""
    return rf"<(?:{names})(?:[\s/]{_INSIDE})?>"


def _until_closed(name: str) -> str:
    """Rest of an element whose content is not markup, up to its close or the end."""
    return rf"{name}(?:[\s/]{_INSIDE})?>.*?(?:</{name}[^>]*>|\z)"


def _hidden_pattern(names: tuple[str, ...]) -> str:
    return r"(?is)<(?:!--.*?(?:-->|\z)|" + "|".join(map(_until_closed, names)) + ")"


_HIDDEN = _hidden_pattern(("script", "style", "noscript", "template"))
_UNSEEN = _hidden_pattern(("script", "style", "noscript", "template", "title", "textarea", "iframe"))
_INERT = _hidden_pattern(("script", "style"))
_ANY_TAG = rf"<[A-Za-z/!?]{_INSIDE}>"
_BLOCKS = "|".join(BLOCK_TAGS)
_SIMPLE = "p|li|h[1-6]|tr|dt|dd|pre|figcaption|tbody|thead|tfoot"


def strip_hidden(html: Column) -> Column:
    """Drop comments, scripts, styles, noscript and template elements.

    One pass with an alternation: whatever opens first wins, so a comment mark
    inside a script (or a tag inside a comment) is not taken for markup.
    """
    return F.regexp_replace(html, _HIDDEN, "")


def strip_inert(html: Column) -> Column:
    """Drop comments, scripts and styles; noscript and template elements stay."""
    return F.regexp_replace(html, _INERT, "")


def strip_unseen(html: Column) -> Column:
    """As :func:`strip_hidden`, also without the title, text areas and frames."""
    return F.regexp_replace(html, _UNSEEN, "")


def tokens(clean: Column) -> Column:
    """Tags and text runs in document order."""
    return F.regexp_extract_all(clean, F.lit(rf"{_ANY_TAG}|[^<]+|<"), F.lit(0))


def strip_tags(fragment: Column) -> Column:
    return F.regexp_replace(fragment, _ANY_TAG, "")


def _code_point(cp: Column) -> Column:
    valid = cp.between(1, 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
    return F.when(
        valid, F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")
    ).otherwise(F.lit("�"))


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in pairs.items())), F.lit("\x01"), F.lit("\x02"))


def decode_entities(text: Column) -> Column:
    """Decode character references in one pass; unknown names stay as they are.

    As browsers do: all names of HTML5, the old ones also without a semicolon, numbers
    of any length, and those of the Windows code page as its characters.
    """
    common, every = _literal_map(ENTITIES), _literal_map(_EVERY)
    renumbered = F.create_map(*[F.lit(x).cast("long") for pair in _RENUMBERED.items() for x in pair])

    def number(p: Column) -> Column:
        digits = F.regexp_extract(p, r"^#0*([0-9]{1,12})", 1)
        hexed = F.regexp_extract(p, r"^#[xX]0*([0-9a-fA-F]{1,9})", 1)
        value = F.when(hexed != "", F.conv(hexed, 16, 10).cast("long")).otherwise(digits.try_cast("long"))
        char = let(let(value, lambda n: F.coalesce(F.try_element_at(renumbered, n), n, F.lit(0))), _code_point)
        return F.concat(char, F.regexp_replace(p, r"^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", ""))

    def named(p: Column, name: Column) -> Column:
        known = F.coalesce(F.try_element_at(common, F.rtrim(name, F.lit(";"))), F.try_element_at(every, name))
        whole = F.when(name.endswith(";"), known)
        prefix = F.regexp_extract(p, f"^(?:{_OPEN_ENDED})", 0)
        cut = F.concat(F.try_element_at(every, prefix), F.substr(p, F.length(prefix) + 1))
        return F.coalesce(F.concat(whole, F.substr(p, F.length(name) + 1)), cut, F.concat(F.lit("&"), p))

    def piece(p: Column) -> Column:
        return (
            F.when(p.rlike(r"^#(?:[0-9]|[xX][0-9a-fA-F])"), number(p))
            .when(p.rlike("^[A-Za-z]"), let(F.regexp_extract(p, r"^[A-Za-z][A-Za-z0-9]*;?", 0), lambda n: named(p, n)))
            .otherwise(F.concat(F.lit("&"), p))
        )

    def decode(t: Column) -> Column:
        pieces = F.transform(F.split(t, "&", -1), lambda p, i: F.when(i == 0, p).otherwise(piece(p)))
        return F.when(F.contains(t, F.lit("&")), F.array_join(pieces, "")).otherwise(t)

    return let(text, decode)


def attributes(tag: Column) -> Column:
    """The ``name=value`` pairs of one tag, as they are written.

    They are read one after the other, so a name inside another attribute's
    value is not taken for an attribute.
    """
    return F.regexp_extract_all(
        tag, F.lit(r"""(?<=[\s"'/])[^\s"'<>/=]+\s*=\s*(?:"[^"]*+"|'[^']*+'|[^\s"'>]+)"""), F.lit(0)
    )


def pick(pairs: Column, name: str) -> Column:
    """Raw value of an attribute from :func:`attributes`, NULL if it is absent."""
    named = F.get(F.filter(pairs, lambda p: p.rlike(rf"(?i)^{name}\s*=")), F.lit(0))

    def unquote(v: Column) -> Column:
        quoted = v.startswith('"') | v.startswith("'")
        return F.when(quoted, F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)

    return let(let(named, lambda p: F.ltrim(F.substr(p, F.instr(p, "=") + 1), F.lit(" \t\r\n\f"))), unquote)


def attribute(tag: Column, name: str) -> Column:
    return pick(attributes(tag), name)


def elements(html: Column, names: str) -> Column:
    """All opening tags with one of the names."""
    return F.regexp_extract_all(html, F.lit("(?i)" + tag_pattern(names)), F.lit(0))


def block_segments(clean: Column) -> Column:
    """Cut a page before its block tags; each piece starts with that tag.

    Closing tags of simple blocks are dropped where another block tag follows,
    line breaks become blanks and table cells are set apart by bars.
    """

    def cut(page: Column) -> Column:
        cells = F.when(
            page.rlike(r"(?i)<t[dh][\s>]"), F.regexp_replace(page, r"(?i)<t[dh](?=[\s>])", " | $0")
        ).otherwise(page)
        merged = F.regexp_replace(
            cells, rf"(?i)<(?:br[^>]*>|/(?:{_SIMPLE})\s*>\s*(?=</?(?:{_BLOCKS})[\s/>]))", " "
        )
        return F.split(merged, rf"(?i)(?=</?(?:{_BLOCKS})[\s/>])", -1)

    return let(clean, cut)
