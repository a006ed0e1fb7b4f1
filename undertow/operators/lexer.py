"""Which parts of a source text are code, and which symbol each part of the code belongs to.

Two automata with stacks run over arrays of tokens as column expressions, so nothing leaves the JVM:

`lexed` tells code from comments, strings, template literals, regular expressions and JSX text, and blanks out what is no
code; what stands in `${...}` of a template or in braces inside JSX is code again, to any depth. Blanked texts keep their
line ends. A slash begins a regular expression, and a `<` with a name a JSX tag, where an operand may begin; the latter
only where tags are allowed.

`structure` matches braces: a definition holds what stands between it and the end of its body, definitions inside others
included. The body is the first block outside of the parameters; an arrow function without a block ends with its
statement (a semicolon, or a line's end outside of brackets).

Both take time in proportion to the text, but for the square of the number of chunks (see fold.running).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from undertow.functions.fold import let, popped, pushed, running, top

_NAME = r"[A-Za-z_$][\w$]*+"
# Marks that a mode may turn on, one by one; anything else in runs.
_ATOM = r"(?s)//|/\*|\*/|\$\{|=>|</|/>|<>|<[A-Za-z_$][\w$.:-]*+(?!\s*,|\s+extends\b)|\\.|[\s&&[^\n]]++|(?:[^\s/*$=<>`'\"\[\]{}\\,]|\$(?!\{)|=(?!>))++|."
#: Where an operand may begin: after these marks and words, and at the start.
_OPENS = r"(?:^|[(,=:\[!&|?;{}*%~^>]|(?<!\+)\+|(?<!-)-|(?<![\w$.])(?:return|typeof|case|in|of|delete|void|throw|new|else|do|await|yield|default|extends))$"
_TAG = "^<[A-Za-z_$]"
TAG, MARK = "\x02", "\x01"  # a tag begins; a method's name begins, whose token would look like a call's

# Modes: c code, l and b comments, s and d strings, t template, r regular expression, k its class, g tag, q and p strings in
# a tag, x JSX text, e closing tag.


def _state(mode: Column | str, stack: Column, last: Column | str) -> Column:
    return F.struct((F.lit(mode) if isinstance(mode, str) else mode).alias("m"), stack.alias("st"), (F.lit(last) if isinstance(last, str) else last).alias("last"))


def _step(tags: Column):
    def step(s: Column, a: Column) -> Column:
        m, st, last = s["m"], s["st"], s["last"]
        back = lambda to: _state(F.coalesce(top(st), F.lit("c")), popped(st), to)
        into = lambda mode, to=last: _state(mode, pushed(st, m), to)
        stay = _state(m, st, last)
        opens, line = last.rlike(_OPENS), a.isin("\n", "\\\n")
        comment = lambda rest: F.when(a == "//", into("l")).when(a == "/*", into("b")).otherwise(rest)
        code = (
            F.when(a.rlike(r"^\s+$"), stay).when(a == "'", into("s", a)).when(a == '"', into("d", a)).when(a == "`", into("t", a))
            .when(a.startswith("/") & opens, into("r", F.lit("/"))).when(tags & a.startswith("<") & opens & (a == "<>"), into("x", F.lit(")"))).when(tags & a.rlike(_TAG) & opens, into("g", F.lit("<")))
            .when(a.isin("{", "${"), into("c", F.lit("{"))).when(a == "}", back("}")).otherwise(_state(m, st, a))
        )
        tag = (
            F.when(a == ">", _state("x", st, ")")).when(a == "/>", back(")")).when(a == '"', into("q")).when(a == "'", into("p")).when(a == "{", into("c", F.lit("{")))
            .when(a == ",", back(a)).when(a.rlike(r"^\s+$"), stay).otherwise(_state(m, st, "a"))
        )
        children = F.when(a == "{", into("c", F.lit("{"))).when(a == "</", _state("e", st, last)).when(a == "<>", into("x")).when(a.rlike(_TAG), into("g", F.lit("<"))).otherwise(stay)
        template = F.when(a == "`", back("`")).when(a == "${", into("c", F.lit("{"))).otherwise(stay)
        regex = F.when((a.startswith("/") | a.isin("*/", "</")) | line, back("/")).when(a == "[", _state("k", st, last)).otherwise(stay)
        return (
            F.when(m == "c", comment(code)).when(m == "x", children).when(m == "g", comment(tag)).when(m == "t", template)
            .when(m == "l", F.when(a.endswith("\n"), back(last)).otherwise(stay)).when(m == "b", F.when(a == "*/", back(last)).otherwise(stay))
            .when(m == "s", F.when(a.isin("'", "\n"), back("'")).otherwise(stay)).when(m == "d", F.when(a.isin('"', "\n"), back('"')).otherwise(stay))
            .when(m == "q", F.when(a == '"', back("a")).otherwise(stay)).when(m == "p", F.when(a == "'", back("a")).otherwise(stay))
            .when(m == "r", regex).when(m == "k", F.when(line, back("/")).when(a == "]", _state("r", st, last)).otherwise(stay))
            .otherwise(F.when(a == ">", back(")")).otherwise(stay))
        )

    return step


def _emit(tags: Column):
    """c code, g a tag, s text of a string, blank for the rest."""

    def emit(s: Column, a: Column) -> Column:
        m = s["m"]
        opens = s["last"].rlike(_OPENS)
        code = F.when(a.isin("//", "/*") | (a.startswith("/") & opens), " ").when(a == "<>", F.when(tags & opens, " ").otherwise("c")).when(a.rlike(_TAG), F.when(tags & opens, "g").otherwise("c")).otherwise("c")
        return (
            F.when(m == "c", code).when(m == "x", F.when(a == "{", "c").when(a.rlike(_TAG), "g").otherwise(" ")).when(m == "g", F.when(a.isin("{", ">", "/>"), "c").otherwise(" "))
            .when(m == "t", F.when(a.isin("`", "${"), "c").otherwise(" ")).when((m == "s") & (a != "'") | (m == "d") & (a != '"'), F.when(a == "\n", " ").otherwise("s")).when(m.isin("s", "d"), "c").otherwise(" ")
        )

    return emit


def lexed(source: Column, tags: Column) -> Column:
    """struct<code, full>: the text with all but code blanked out, and the same with the strings' texts. A tag's `<` becomes
    TAG, which tells it from other uses. `tags` tells whether JSX may occur."""
    zero = _state("c", F.array().cast("array<string>"), "")
    blank = lambda a: F.regexp_replace(a, r"[^\n]", " ")

    def text(read: Column, strings: bool) -> Column:
        shown = lambda a, k: F.when((k == "c") & (a == "${"), " {").when(k == "g", F.concat(F.lit(TAG), F.substring(a, 2, 1 << 30))).when((k == "c") | (k == "s") & F.lit(strings), a).otherwise(blank(a))
        return F.array_join(F.zip_with(read["atoms"], read["kinds"], shown), "")

    def texts(atoms: Column) -> Column:
        kinds = running(atoms, zero, _step(tags), _emit(tags), "string")
        return let(F.struct(atoms.alias("atoms"), kinds.alias("kinds")), lambda read: F.struct(text(read, False).alias("code"), text(read, True).alias("full")))

    plain = F.translate(source, f"{TAG}{MARK}", "  ")
    return let(F.regexp_extract_all(plain, F.lit(_ATOM), F.lit(0)), texts)


# What matters for scopes, in code alone. Brackets of parameters may nest four deep.
_INNER = r"[^()]++"
for _ in range(3):
    _INNER = rf"(?:[^()]++|\({_INNER}\))*+"
_TYPES = r"(?:<[^<>()]*+>\s*)?"
_PARAMETERS = rf"\({_INNER}\)"
_NOT_NAMED = r"(?<![\w$.])(?<!\bfunction\s{1,3})(?<!\bfunction\s{0,3}\*\s{0,3})(?<!\bclass\s{1,3})(?<!\bnew\s{1,3})"
_WORDS = r"(?!(?:if|for|while|switch|catch|function|return|typeof|await|new|import|super|with|class|else|do|case)\b)"
_EXPORT = r"(?:\bexport\s+(?:default\s+)?)?"
CLASS = rf"(?<![\w$.]){_EXPORT}(?:abstract\s+)?\bclass\s+(?!extends\b|implements\b){_NAME}"
FUNCTION = rf"(?<![\w$.])(?<![=(,:?&|]\s{{0,3}})(?<!\breturn\s{{1,3}})(?<!\basync\s{{1,3}}){_EXPORT}(?:async\s+)?\bfunction\b\s*\*?\s*{_NAME}"
VARIABLE = rf"(?<![\w$.]){_EXPORT}\b(?:const|let|var)\s+{_NAME}\s*(?::[^=;]++)?=\s*(?:async\b\s*)?(?:function\b\s*\*?(?:\s*{_NAME})?|{_NAME}\s*=>|(?={_TYPES}{_PARAMETERS}[^=;{{}}]*+=>))"
METHOD = rf"{_NOT_NAMED}{_WORDS}#?{_NAME}\s*(?={_TYPES}{_PARAMETERS}\s*(?::[^{{}};=()]++)?\{{)"
CALL = rf"{_NOT_NAMED}{_WORDS}{_NAME}\s*{_TYPES}\("
RENDER = rf"{TAG}[A-Z][\w$.]*+"
_PLACE = rf"{CLASS}|{FUNCTION}|{VARIABLE}|{MARK}#?{_NAME}\s*{_TYPES}\(|{RENDER}|{CALL}|=>|[(){{}}\[\];\n]|[^\s(){{}}\[\];=\w$.]|[\w$.]++"


def structure(code: Column) -> Column:
    """Array of struct<kind, name, line, depth, holder, exported> of the definitions (class, function, method), tags
    (render) and calls of a blanked text. `holder` is the innermost definition around, `depth` the open blocks."""
    marked = F.regexp_replace(code, METHOD, f"{MARK}$0")
    tokens = F.regexp_extract_all(marked, F.lit(_PLACE), F.lit(0))
    known = F.transform(tokens, lambda t: F.struct(t.alias("t"), _kind(t).alias("k")))
    zero = F.struct(F.lit(1).alias("line"), F.array().cast("array<string>").alias("st"), F.lit(0).alias("round"), F.lit(None).cast("string").alias("next"), F.lit(0).alias("at"), F.lit(0).alias("deep"), F.lit("").alias("arrow"))
    kind = "struct<kind:string,name:string,line:int,depth:int,holder:string,exported:boolean>"

    def holder(s: Column) -> Column:
        return F.coalesce(s["next"], F.nullif(top(s["st"]), F.lit("")))

    def step(s: Column, x: Column) -> Column:
        t, k = x["t"], x["k"]
        new = lambda **c: F.struct(*[c.get(n, s[n]).alias(n) for n in ("line", "st", "round", "next", "at", "deep", "arrow")])
        lines = (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("int")
        none, level = F.lit(None).cast("string"), s["round"] == s["at"]
        begins = new(line=s["line"] + lines, next=_name(t, k), at=s["round"], deep=F.size(s["st"]), round=s["round"] + F.when(k == "method", 1).otherwise(0), arrow=F.when(t.endswith("=>"), "body").when((k == "function") & t.rlike(r"=\s*(?:async\s*)?$"), "head").otherwise(""))
        ends = s["next"].isNotNull() & level & (s["arrow"] == "more")
        body = s["next"].isNotNull() & level & s["arrow"].isin("", "body")
        more = F.when(s["arrow"] == "body", "more").otherwise(s["arrow"])
        closes = F.size(s["st"]) <= s["deep"]
        return (
            F.when(k.isin("class", "function", "method"), begins)
            .when(k == "call", new(line=s["line"] + lines, round=s["round"] + 1, arrow=more)).when(t == "\n", new(line=s["line"] + 1, next=F.when(~ends, s["next"])))
            .when(t == "{", F.when(body, new(st=pushed(s["st"], s["next"]), next=none)).otherwise(new(st=pushed(s["st"], F.coalesce(holder(s), F.lit(""))), arrow=more)))
            .when(t == "}", new(st=popped(s["st"]), next=F.when(~closes, s["next"])))
            .when(t.isin("(", "["), new(round=s["round"] + 1, arrow=more)).when(t.isin(")", "]"), new(round=s["round"] - 1, next=F.when(s["round"] - 1 >= s["at"], s["next"])))
            .when(t == ";", new(next=F.when(~level, s["next"])))
            .when(t == "=>", new(arrow=F.when((s["arrow"] == "head") & level, "body").otherwise(s["arrow"]))).otherwise(new(line=s["line"] + lines, arrow=more))
        )

    def emit(s: Column, x: Column) -> Column:
        t, k = x["t"], x["k"]
        return F.when(k != "", F.struct(k.alias("kind"), _name(t, k).alias("name"), s["line"].alias("line"), F.size(s["st"]).alias("depth"), holder(s).alias("holder"), ((F.size(s["st"]) == 0) & t.rlike(r"^export\b")).alias("exported")))

    return F.filter(running(known, zero, step, emit, kind), lambda x: x.isNotNull())


def _kind(t: Column) -> Column:
    """Of a token of `structure`; empty for brackets, line ends and other code."""
    return (
        F.when(t.rlike(rf"^{_EXPORT}(?:abstract\s+)?class\s+[\w$]"), "class").when(t.rlike(rf"^{_EXPORT}(?:(?:async\s+)?function\b|(?:const|let|var)\s+[^\s])") & t.rlike(r"[\s*]"), "function")
        .when(t.startswith(MARK), "method").when(t.rlike(r"^[\w$][^=]*\($"), "call").when(t.startswith(TAG), "render").otherwise("")
    )


def _name(t: Column, k: Column) -> Column:
    return (
        F.when(k == "class", F.regexp_extract(t, r"class\s+([\w$]+)", 1)).when(k == "function", F.regexp_extract(t, r"(?:\bfunction\b\s*\*?|\b(?:const|let|var)\b)\s*([\w$]+)", 1))
        .otherwise(F.regexp_extract(t, r"([A-Za-z_$][\w$]*)", 1))
    )
