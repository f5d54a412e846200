"""Text functions as SQL expressions over SQL expressions.

Each takes and returns SQL text, so that they nest inside lambdas. `let` binds a value once: a column that is inlined into
a lambda by the optimizer would else be computed for each element. Work on tokens stays inside lambdas: as columns it would
make generated methods too long for the JVM to compile.
"""

from __future__ import annotations

from docspark.functions.words import CITATION_MARKS, META_WORDS, STOPWORDS

BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
TOKEN = r"[A-Za-z][A-Za-z0-9']*|\p{Nd}+(?:[.,]\p{Nd}+)*"
SENTENCE_GAP = r"""(?<=[.!?])[\s\x1c-\x1f\x85\p{Z}]+(?=["'(\[]?[A-Z0-9])"""


def quoted(value: str) -> str:
    """An SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def words_in(values) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def strip(text: str) -> str:
    return f"regexp_replace({text}, {quoted(f'^{BLANK}+|{BLANK}+$')}, '')"


def clean(text: str) -> str:
    """NULs and URLs to blanks; hyphenated line ends and citation marks out; runs of blanks and tabs to one; stripped.

    Each step is left out of texts without a sign of it, which a plain search tells.
    """
    marked = rf"(?i)\[{BLANK}*(?:\p{{Nd}}+|citation needed|note \p{{Nd}}+){BLANK}*\]"
    steps = [("-\\n(?=[a-z])", "", "contains(c, '-\\n')"), (marked, "", "contains(c, '[')"), (r"(?:https?://|www\.)[^\s\x1c-\x1f\x85\p{Z}]+", " ", "contains(c, '://') or contains(c, 'www.')"), (r"[ \t]+", " ", "contains(c, '  ') or contains(c, '\\t')")]
    out = let("c", text, "if(contains(c, '\\0'), translate(c, '\\0', ' '), c)")
    for pattern, to, sign in steps:
        out = let("c", out, f"if({sign}, regexp_replace(c, {quoted(pattern)}, {quoted(to)}), c)")
    return let("c", out, f"if(left(c, 1) rlike {quoted(BLANK)} or right(c, 1) rlike {quoted(BLANK)}, {strip('c')}, c)")


def flatten(text: str) -> str:
    """Runs of white space to one blank; stripped."""
    return f"trim(regexp_replace({text}, {quoted(BLANK + '+')}, ' '))"


def pages(text: str, size: int = 3000) -> str:
    """Slices of `size` characters; an empty text is one empty page."""
    return f"if(length({text}) = 0, array(''), transform(sequence(0, (length({text}) - 1) div {size}), i -> substring({text}, cast(i * {size} + 1 as int), {size})))"


def sentences(text: str) -> str:
    """Sentences longer than one character."""
    return f"filter(transform(split({flatten(text)}, {quoted(SENTENCE_GAP)}), s -> trim(s)), s -> length(s) > 1)"


#: Suffixes in the order tried, what replaces them. Fixed values.
SUFFIXES = (("ies", "y"), ("sses", "ss"), ("ations", "ate"), ("ation", "ate"), ("ingly", ""), ("edly", ""), ("ing", ""), ("ness", ""), ("ment", ""), ("ed", ""), ("ly", ""), ("es", ""), ("s", ""))


def stem(word: str) -> str:
    """Stem of a lower-case word: the first suffix that leaves three characters goes, then one of a doubled last letter."""
    cases = []
    for suffix, to in SUFFIXES:
        whole = "v" if suffix != "s" else "if(v like '%ss', v, left(v, length(v) - 1))"
        cut = f"concat(left(v, length(v) - {len(suffix)}), '{to}')" if suffix != "s" else whole
        cases.append(f"when v like '%{suffix}' and length(v) >= {len(suffix) + 3} then {cut}")
    bare = let("u", f"regexp_replace({word}, {quoted(chr(94) + chr(91) + chr(39) + '-]+|[' + chr(39) + '-]+$')}, '')", "if(u like '%\\'s', left(u, length(u) - 2), u)")
    doubled = "length(x) > 4 and right(x, 1) = substring(x, -2, 1) and right(x, 1) not in ('l', 's')"
    shorter = let("x", f"case {' '.join(cases)} else v end", f"if({doubled}, left(x, length(x) - 1), x)")
    return let("v", bare, f"if(length(v) <= 3 or v rlike '^\\\\p{{Nd}}+$', v, {shorter})")


def stemmed(word: str) -> str:
    """The stem of a word of a fixed list, as `stem` gives it, without a query."""
    word = word.strip("'-").removesuffix("'s")
    if len(word) <= 3 or word.isdecimal():
        return word
    suffix, to = next(((s, to) for s, to in SUFFIXES if word.endswith(s) and len(word) >= len(s) + 3), ("", ""))
    if suffix and not (suffix == "s" and word.endswith("ss")):
        word = word[: -len(suffix)] + to
    return word[:-1] if len(word) > 4 and word[-1] == word[-2] and word[-1] not in "ls" else word


def raw_tokens(text: str) -> str:
    return f"regexp_extract_all({text}, {quoted(TOKEN)}, 0)"


def content_tokens(text: str) -> str:
    """Lower-case tokens that are no stopwords, in order."""
    return f"filter(transform({raw_tokens(text)}, t -> lower(t)), t -> t not in {words_in(STOPWORDS)})"


def terms(text: str) -> str:
    """Stems of the tokens that are no stopwords, in order."""
    return f"transform({content_tokens(text)}, t -> {stem('t')})"


def query_terms(text: str) -> str:
    """Distinct stems of the tokens that are neither stopwords nor about the question, in order."""
    return f"array_distinct(transform(filter(transform({raw_tokens(text)}, t -> lower(t)), t -> t not in {words_in(dict.fromkeys(STOPWORDS + META_WORDS))}), t -> {stem('t')}))"


def proper_terms(text: str) -> str:
    """Stems of capitalised tokens after the first."""
    return f"transform(filter(filter({raw_tokens(text)}, (t, i) -> i > 0 and t rlike '^[A-Z]'), t -> lower(t) not in {words_in(dict.fromkeys(STOPWORDS + META_WORDS))}), t -> {stem('lower(t)')})"


def spans(text: str) -> str:
    """(stem, first, end) of the tokens that are no stopwords; characters from 0, end excluded."""
    lengths = "aggregate(zip_with(gs, ts, (g, t) -> named_struct('g', length(g), 't', length(t))), named_struct('at', 0, 'out', cast(array() as array<struct<first:int,end:int>>)), (a, p) -> if(p.t is null, a, named_struct('at', a.at + p.g + p.t, 'out', concat(a.out, array(named_struct('first', a.at + p.g, 'end', a.at + p.g + p.t))))), a -> a.out)"
    all_ = let("ts", raw_tokens(text), let("gs", f"split({text}, {quoted(TOKEN)}, -1)", f"zip_with(ts, {lengths}, (t, p) -> named_struct('t', lower(t), 'first', p.first, 'end', p.end))"))
    return f"transform(filter({all_}, p -> p.t not in {words_in(STOPWORDS)}), p -> named_struct('stem', {stem('p.t')}, 'first', p.first, 'end', p.end))"


def highlights(text: str, wanted: str) -> str:
    """Spans of the wanted stems; those at most one character apart are joined."""
    found = f"filter({spans(text)}, p -> array_contains({wanted}, p.stem))"
    joined = "if(size(a) > 0 and p.first - element_at(a, -1).end <= 1, concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', p.end))), concat(a, array(named_struct('start', p.first, 'end', p.end))))"
    return f"aggregate({found}, cast(array() as array<struct<start:int,end:int>>), (a, p) -> {joined})"


def letter_share(text: str) -> str:
    return f"length(regexp_replace({text}, '[^\\\\p{{L}}]', '')) / length({text})"


def citation_marks(text: str) -> str:
    return f"regexp_count({text}, {quoted('(?U)' + chr(92) + 'b(?:' + '|'.join(CITATION_MARKS) + ')' + chr(92) + 'b')})"


def dedupe_key(text: str) -> str:
    return f"left(regexp_replace(lower({text}), '(?U)\\\\W+', ''), 80)"


def _rfind(window: str, needle: str) -> str:
    """Place of the last `needle` in an SQL text, from 0, or -1."""
    return f"coalesce(nullif(length({window}) + 1 - instr(reverse({window}), {quoted(needle[::-1])}), length({window}) + 1) - {len(needle)}, -1)"


def chunks(text: str, size: int = 1000, overlap: int = 180, least: int = 40) -> str:
    """Windows of up to `size` characters of the flattened text, longer than `least`.

    A window that isn't the last ends after the last `. ` or `? ` in its second half, else after the last blank there.
    The next begins `overlap` characters before, at a word. Each step goes on by 321 characters at least, which bounds the fold.
    """
    half = size // 2
    window = f"substring(f, a.pos + {half + 1}, {half})"
    stop = let("c", f"greatest({_rfind('w', '. ')}, {_rfind('w', '? ')})", f"if(c >= 0, c, {_rfind('w', ' ')})")
    end = f"if(a.pos + {size} < length(f), {let('w', window, let('c', stop, f'if(c >= 0, a.pos + {half} + c + 1, a.pos + {size})'))}, length(f))"
    piece = "trim(substring(f, a.pos + 1, e - a.pos))"
    grown = let("p", piece, f"if(length(p) > {least}, concat(a.out, array(p)), a.out)")
    follow = let("q", f"greatest(e - {overlap}, a.pos + 1)", let("b", "locate(' ', f, q + 1)", "if(b > 0 and b - 1 < e, b, q)"))
    step = let("e", end, f"named_struct('pos', {follow}, 'done', e >= length(f), 'out', {grown})")
    bound = f"sequence(1, length(f) div {half - overlap + 1} + 1)"
    fold = f"aggregate({bound}, named_struct('pos', 0, 'done', length(f) = 0, 'out', cast(array() as array<string>)), (a, k) -> if(a.done, a, {step}), a -> a.out)"
    return let("f", flatten(text), fold)
