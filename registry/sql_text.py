"""SQL spellings of the text steps, for an engine without look-around.

Every function takes and gives an SQL expression. Where a step looks at the
neighbours of a character, kept characters are set aside under a control
character first.
"""

from corrspark import lexicon

W = r"[\p{L}\p{N}_]"
BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
TOKEN = rf"{W}+(?:[.\-]{W}+)*|[^\p{{L}}\p{{N}}_\s]"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({x}, {quote(pattern)}, {quote(new)}, 'g')"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def runs(x: str) -> str:
    return strip(sub(x, r"\s{2,}", " "))


def blanks(x: str) -> str:
    return strip(sub(x, r"\s+", " "))


def marked(x: str, pattern: str, new: str) -> str:
    """Replace with a pattern whose replacement may hold the mark (@)."""
    return f"regexp_replace({x}, {quote(pattern)}, replace({quote(new)}, '@', chr(1)), 'g')"


def puncts(x: str) -> str:
    x = marked(f"translate({x}, ';,', '')", r"\.(\s+[A-Z])", r"@\1")
    x = f"regexp_replace({x}, '({W})' || chr(1), '\\1', 'g')"
    return blanks(f"replace({x}, chr(1), '.')")


def space(x: str) -> str:
    return runs(f"translate({x}, chr(10) || chr(9) || chr(13), '   ')")


def links(x: str) -> str:
    return runs(sub(x, r"(^|[^\p{L}\p{N}_])(https?://\S+|www\.\S+)", r"\1"))


def digits(x: str) -> str:
    return runs(sub(x, r"\d+"))


def drop_marks(x: str, doomed: str) -> str:
    return f"translate({x}, {quote('-/' + doomed)}, '  ')"


def punctuation(x: str, preserve: bool = True) -> str:
    doomed = "!\"#$%&'()*+,.:;<=>?@[\\]^_`{|}~"
    if preserve:
        x = marked(x, rf"({W})\.", r"\1@")
        x = marked(x, rf"\.({W})", r"@\1")
        return f"replace({drop_marks(x, doomed)}, chr(1), '.')"
    return drop_marks(x, doomed)


def parentheses(x: str) -> str:
    return runs(sub(x, r"\(.*?\)"))


def special(x: str) -> str:
    return runs(sub(x, r"[^\p{L}\p{N}_\s]"))


def dates(x: str) -> str:
    x = sub(x, r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b")
    x = sub(x, r"\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b")
    return runs(sub(x, r"(?i)\b(" + "|".join(lexicon.MONTHS) + r")\b"))


def versions(x: str) -> str:
    phrases = [p for p in lexicon.VERSION_PHRASES if "(?<" not in p]
    x = sub(x, "(?i)(" + "|".join(phrases) + ")")
    x = runs(sub(x, r"\s*,\s*", ", "))
    return sub(x, r"\s*,\s*$")


def entities(x: str) -> str:
    for pattern in (r"CVE-\d{4}-\d{4,7}", r"CWE-\d{1,5}", r"CAPEC-\d{1,5}"):
        x = sub(x, "(?i)" + pattern)
    return blanks(x)


PATH = r"(?:[A-Za-z]:)?[/][\p{L}\p{N}_.-]+(?:[/][\p{L}\p{N}_.-]+)*"


def paths(x: str) -> str:
    return blanks(sub(x, PATH))


def file_names(x: str) -> str:
    return blanks(sub(x, r"\b\w+\.(" + "|".join(lexicon.FILE_EXTENSIONS) + r")\b"))


def words(x: str) -> str:
    return f"[w FOR w IN string_split_regex({strip(x)}, '\\s+') IF w <> '']"


def stop_words(x: str) -> str:
    listed = ", ".join(quote(w) for w in lexicon.STOPWORDS)
    return f"array_to_string([w FOR w IN {words(x)} IF lower(w) NOT IN ({listed})], ' ')"


def sentences(x: str) -> str:
    return runs(sub(x, r"([.!?])\s+", r"\1 "))


def tokens(x: str) -> str:
    return f"array_to_string(regexp_extract_all({x}, {quote(rf'{W}+(?:[.' + chr(39) + rf'\-]{W}+)*')}), ' ')"


def genitive(x: str) -> str:
    x = sub(x, rf"({W}+)'s\s+({W}+)", r"\2 of \1")
    return runs(sub(x, rf"({W}+)'\s+({W}+)", r"\2 of \1"))


def aggregation(x: str) -> str:
    x = f"translate(lower(coalesce({x}, '')), '/-', '  ')"
    return blanks(sub(x, r"[^\p{L}\p{N}_\s]"))


def uniform(x: str) -> str:
    x = marked(x, r"([0-9])\.", r"\1@")
    x = marked(x, r"([\p{L}_])\.([0-9])", r"\1@\2")
    x = marked(x, r"\.([0-9][\p{L}\p{N}_])", r"@\1")
    x = f"replace(replace({x}, '.', ' '), chr(1), '.')"
    return blanks(f"lower(translate({x}, '_-/(),;', '       '))")


def service(x: str) -> str:
    """The pipeline with the defaults of a correlation request."""
    return puncts(space(versions(space(f"lower({puncts(x)})"))))
