"""Column functions over text: tokenizers, prompt rendering, response parsing, shingles.

All functions take and return ``Column`` objects and compile to built-in Spark
expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------
# Characters Python's ``str.split()`` treats as whitespace (Unicode White_Space plus the
# information separators U+001C..U+001F). Written with ``\x{..}`` escapes, which both the
# Java and the RE2 regex engines accept.
WHITESPACE_CLASS = (
    r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# Start-of-sequence token of the word tokenizer, and the special tokens dropped by
# ``drop_special``.
BOS = "<s>"
EOS = "</s>"
PAD = "<pad>"
SPECIAL_TOKENS = (BOS, EOS, PAD)
# Marker that separates the model's answer from the echoed instruction.
RESPONSE_MARKER = "### Response"
# Fence that opens a code block.
FENCE = "```"
# Default chat template, after the ``{language}`` substitution stage: ``{language}`` is
# filled first, then ``{{ bos_token }}`` and ``{{ messages }}`` (the prompt, twice).
DEFAULT_CHAT_TEMPLATE = (
    "{{ bos_token }} You are an exceptionally intelligent coding assistant that consistently "
    "delivers accurate and reliable responses to user instructions.\n"
    "\n"
    "### Instruction\n"
    "Complete the function in the code snippet:\n"
    "```{language}\n"
    "{{ messages }}\n"
    "```\n"
    "\n"
    "### Response\n"
    "Here's how you can complete the function:\n"
    "```{language}\n"
    "{{ messages }}\n"
)
# --- end of fixed values ------------------------------------------------------------------

WS_RUN = "[" + WHITESPACE_CLASS + "]+"
LEADING_WS = "^[" + WHITESPACE_CLASS + "]+"
TRAILING_WS = "[" + WHITESPACE_CLASS + "]+$"
# Code tokenizer: identifiers, digit runs, or any single other non-space character.
CODE_TOKEN_PATTERN = "[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^A-Za-z0-9_" + WHITESPACE_CLASS + "]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokenize_words(text) -> Column:
    """Whitespace tokenizer with the semantics of ``str.split()``: runs of whitespace
    separate tokens, empty strings are dropped, NULL text gives an empty array."""
    t = _c(text)
    parts = F.split(F.coalesce(t, F.lit("")), WS_RUN)
    return F.filter(parts, lambda x: x != F.lit(""))


def tokenize_code(text) -> Column:
    """Code tokenizer: identifiers, integer literals and single punctuation characters."""
    t = F.coalesce(_c(text), F.lit(""))
    return F.regexp_extract_all(t, F.lit(CODE_TOKEN_PATTERN), 0)


def lstrip_ws(text) -> Column:
    return F.regexp_replace(_c(text), LEADING_WS, "")


def strip_ws(text) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(text), LEADING_WS, ""), TRAILING_WS, "")


def add_bos(tokens, bos: str = BOS) -> Column:
    """Prepend the start token to a token array."""
    return F.concat(F.array(F.lit(bos)), _c(tokens))


def first_line(text) -> Column:
    return F.substring_index(_c(text), "\n", 1)


def _template_segments(template: str, language_filled: bool):
    """Split a template into literal pieces and placeholders (driver side, template only)."""
    keys = ["{{ bos_token }}", "{{ messages }}"]
    if not language_filled:
        keys.append("{language}")
    out, i = [], 0
    while i < len(template):
        nxt = [(template.find(k, i), k) for k in keys]
        nxt = [(p, k) for p, k in nxt if p >= 0]
        if not nxt:
            out.append(("lit", template[i:]))
            break
        p, k = min(nxt)
        if p > i:
            out.append(("lit", template[i:p]))
        out.append(("var", k))
        i = p + len(k)
    return out


def render_prompt(prompt, language, template: str | None = None, bos: str = BOS) -> Column:
    """Fill a chat template: ``{language}`` first, then ``{{ bos_token }}`` and
    ``{{ messages }}`` (the prompt). The prompt is placed last, as a column, so braces in
    it are never read as placeholders. A single trailing newline of the template output
    is dropped, as a template engine without ``keep_trailing_newline`` does."""
    template = template if template is not None else DEFAULT_CHAT_TEMPLATE
    if template.endswith("\n"):
        template = template[:-1]
    values = {"{{ bos_token }}": F.lit(bos), "{{ messages }}": _c(prompt), "{language}": _c(language)}
    parts = []
    for kind, v in _template_segments(template, language_filled=False):
        parts.append(F.lit(v) if kind == "lit" else values[v])
    return F.concat(*parts)


def response_part(text) -> Column:
    """Everything after the last ``### Response`` marker (the whole text when absent)."""
    return F.substring_index(_c(text), RESPONSE_MARKER, -1)


def extract_code(response, language) -> Column:
    """First fenced block of the given language (non-greedy, dot matches newline).
    Fallback: the text after the last opening fence of that language, left-trimmed.
    The language is quoted, so ``c++`` matches literally."""
    resp, lang = _c(response), _c(language)
    pattern = F.concat(F.lit("(?s)" + FENCE + "\\Q"), lang, F.lit("\\E\n(.*?)\n" + FENCE))
    matches = F.regexp_extract_all(resp, pattern, F.lit(1))
    fence = F.concat(F.lit(FENCE), lang)
    fallback = lstrip_ws(_substring_after_last(resp, fence))
    return F.when(F.size(matches) > 0, F.get(matches, 0)).otherwise(fallback)


def _substring_after_last(s: Column, delim: Column) -> Column:
    """``s.split(delim)[-1]`` for a column delimiter."""
    return F.call_function("substring_index", s, delim, F.lit(-1))


def strip_prompt(code, prompt) -> Column:
    """Drop the first ``len(prompt.lstrip())`` characters of the code (no check that they
    equal the prompt)."""
    n = F.char_length(lstrip_ws(_c(prompt)))
    return F.call_function("substring", _c(code), n + F.lit(1))


def complete_code(prompt, generated_code) -> Column:
    return F.concat(_c(prompt), _c(generated_code))


def shingles(words, k: int = 5) -> Column:
    """``k``-word shingles joined by single spaces; fewer than ``k`` words give an empty
    array.

    Built from ``k`` shifted slices zipped together, so the lambda only reads its own
    element: the word array is never re-read (or re-computed) per shingle."""
    w = _c(words)
    m = F.size(w) - F.lit(k - 1)
    parts = [F.slice(w, j + 1, F.greatest(m, F.lit(1))).alias(f"w{j}") for j in range(k)]
    zipped = F.arrays_zip(*parts)
    joined = F.transform(zipped, lambda z: F.concat_ws(" ", *[z[f"w{j}"] for j in range(k)]))
    return F.when(m > 0, joined).otherwise(F.array().cast("array<string>"))


def ngrams(words, n: int) -> Column:
    """All contiguous ``n``-grams, each joined by a single space (tokens hold no spaces)."""
    return shingles(words, n)
