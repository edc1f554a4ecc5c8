"""Model and tool JSON to typed columns, without failing on bad input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories and thresholds that results must match.
CATEGORIES = ["preference", "fact", "habit", "rule"]
LEAST_CONFIDENCE, DEFAULT_CONFIDENCE = 0.3, 0.5
# What error texts call the types of JSON values.
JAVA_TYPES = {"BIGINT": "java.lang.Integer", "DECIMAL": "java.lang.Double", "DOUBLE": "java.lang.Double", "BOOLEAN": "java.lang.Boolean", "STRING": "java.lang.String", "VOID": "org.json.JSONObject$1", "OBJECT": "org.json.JSONObject", "ARRAY": "org.json.JSONArray"}


def strip_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"```json\s*", ""), r"```\s*", ""), F.lit(" \t\n\r"))


def category(raw: Column) -> Column:
    return F.when(raw.isin(*CATEGORIES), raw).otherwise(F.lit("fact"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Pieces of lenient JSON: comments, white space, strings in either quotes, brackets and separators (: or =, a > right after it belongs to it), bare words; anything else alone.
_PIECES = r"""/\*(?s:.*?)\*/|//[^\r\n]*|#[^\r\n]*|[ \t\r\n]+|"(?:[^"\\]++|\\(?s:.))*+"|'(?:[^'\\]++|\\(?s:.))*+'|[{}\[\],;]|[:=]>?|[^{}\[\]/\\:,=;# \t\f\r\n"'][^{}\[\]/\\:,=;# \t\f\r\n]*+|(?s:.)"""
_SKIPPED = r"^(?:[ \t\r\n]|//|/\*(?s:.)|#)"
#: Where a number may stand that JSON functions would write in another way.
_ROUNDED = r"[0-9](?:\.[0-9]*0|[eE])|[0-9.]{16}"
#: Stands for what no parser takes; no JSON has it.
_BAD = "!"


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("a")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _string(piece: Column, device: bool) -> Column:
    """A string in either quotes with the escapes and characters that strict JSON takes. device: an escaped character that means nothing stands for itself."""
    body = F.substring(piece, F.lit(2), F.length(piece) - 2)
    body = F.regexp_replace(body, r"""(\\[ubfnrt"\\/])|\\((?s:.))""" if device else r"""(\\[^'\n])|\\(['\n])""", "$1$2")
    body = F.regexp_replace(body, r'(?<!\\)((?:\\\\)*+)"', r'$1\\"')
    for raw, written in (("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t"), ("\f", r"\\f"), ("\b", r"\\b")):
        body = F.regexp_replace(body, raw if raw != "\b" else r"\x08", written)
    return F.when(F.length(piece) < 2, F.lit(_BAD)).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def _word(word: Column, device: bool) -> Column:
    """A bare word: null, true and false in any case, numbers, else a text. The device reads 0x and 0 as base 16 and 8; numbers that aren't finite are none."""
    low = F.lower(word)
    constant = F.when(low.isin("null", "true", "false"), low)
    if not device:
        return F.coalesce(constant, quoted(word))  # numbers as texts: they keep their digits, and the reader makes no difference
    base = lambda digits, n: F.conv(digits, n, 10)
    hexadecimal = F.when(word.rlike(r"^0[xX][0-9a-fA-F]{1,15}$"), base(F.substring(word, 3, 15), 16))
    octal = F.when(word.rlike(r"^0[0-7]{1,20}$"), base(F.substring(word, 2, 20), 8))
    whole = F.when(word.rlike(r"^(?:0|[+-][0-9]+|[1-9][0-9]*)$"), word.try_cast("bigint").cast("string"))
    real = F.when(word.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[fFdD]?$"), F.regexp_replace(word, "[fFdD]$", "").try_cast("double"))
    endless = word.rlike(r"^[+-]?(?:NaN|Infinity)$") | (F.abs(real) == float("inf"))
    return F.coalesce(constant, hexadecimal, octal, whole, F.when(endless, F.lit(_BAD)), real.cast("string"), quoted(word))


def strict(text: Column, device: bool = True) -> Column:
    """Lenient JSON as strict JSON: bare words, single quotes, = or => for :, ; for commas, comments, empty places in arrays as null. What lenient parsers refuse gives no JSON either.

    device: as the device's own parser reads tool arguments: only the first value counts, names that read as numbers or
    constants are refused. Else as the reader of model output: nothing may follow, any word is a name, and numbers become texts with all their digits.
    """

    def rewritten(pieces: Column) -> Column:
        def one(piece: Column, k: Column) -> Column:
            before, after = F.get(pieces, k - 1), F.get(pieces, k + 1)
            first, gap = F.substring(piece, 1, 1), before.isin(",", ";")
            name = F.substring(after, 1, 1).isin(":", "=")
            word = _word(piece, device)
            as_name = F.when(word.startswith('"'), word).otherwise(F.lit(_BAD)) if device else quoted(piece)
            return (
                F.when(piece.isin("{", "[", "}"), piece)
                .when(piece == "]", F.when(gap, F.lit("null]")).otherwise(piece))
                .when(piece.isin(",", ";"), F.when(gap | (before == "["), F.lit("null,")).otherwise(F.lit(",")))
                .when(piece.isin(":", "=", ":>", "=>"), F.lit(":"))
                .when(first.isin('"', "'"), _string(piece, device))
                .when(piece.isin("/", "\\", "\f"), F.lit(_BAD))
                .when(F.coalesce(name, F.lit(False)), as_name)
                .otherwise(word)
            )

        return F.array_join(F.transform(pieces, one), "")

    def first_value(pieces: Column) -> Column:
        """The pieces of the first value: up to where as many brackets are shut as open."""
        zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

        def step(a: Column, piece: Column) -> Column:
            depth = a["depth"] + F.when(piece.isin("{", "["), 1).when(piece.isin("}", "]"), -1).otherwise(0)
            return F.when(a["done"], a).otherwise(F.struct(depth.alias("depth"), (a["n"] + 1).alias("n"), (depth <= 0).alias("done")))

        return F.slice(pieces, F.lit(1), F.greatest(F.aggregate(pieces, zero, step)["n"], F.lit(1)))

    pieces = F.filter(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), lambda p: ~p.rlike(_SKIPPED))
    lenient = let(let(pieces, first_value) if device else pieces, rewritten)
    plain = F.try_parse_json(text).isNotNull() if device else alone(text) & ~text.rlike(_ROUNDED)
    return F.when(plain, text).otherwise(lenient)


def alone(text: Column) -> Column:
    """Whether a text is one JSON value that nothing follows; Spark's parser doesn't look at what follows."""
    return let(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), lambda v: F.try_variant_get(v, "$[0]", "variant").isNotNull() & F.try_variant_get(v, "$[1]", "variant").isNull())


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is costly to evaluate, and that the optimiser doesn't copy to every place that uses it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _kind(v: Column) -> Column:
    """BOOLEAN, STRING, VOID (JSON null), BIGINT, DECIMAL, DOUBLE, OBJECT or ARRAY of a variant."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def candidates(df: DataFrame, output: str = "model_output") -> DataFrame:
    """One row for each memory candidate of a JSON array: df's other columns, pos, category, key_text, value_text, confidence.

    Text that is no array gives none; elements that are no objects are skipped; an array of one element as a value
    counts as that element, other arrays and objects as missing; keys and values must not be empty and the confidence at
    least LEAST_CONFIDENCE.
    """
    keep = [c for c in df.columns if c != output]
    fields = ["category", "key", "value", "confidence"]
    whole = let(strict(strip_fences(F.col(output)), device=False), lambda x: F.when(alone(x), x))
    rows = df.select(*keep, F.posexplode(F.from_json(whole, "array<string>")).alias("pos", "_j"))
    rows = once(rows, "_e", F.struct(F.try_parse_json("_j").alias("v"), F.from_json("_j", ", ".join(f"{f} string" for f in fields)).alias("t")))
    rows = rows.filter(_kind(F.col("_e.v")) == "OBJECT")

    def inner(path: str, raw: Column, depth: int) -> Column:
        kind = _kind(F.try_variant_get("_e.v", path, "variant"))
        scalar = F.when(~kind.isin("OBJECT", "ARRAY", "VOID"), raw)
        if not depth:
            return scalar
        return scalar.when(kind == "ARRAY", let(F.from_json(raw, "array<string>"), lambda xs: F.when(F.size(xs) == 1, inner(path + "[0]", F.get(xs, F.lit(0)), depth - 1))))

    def text(name: str) -> Column:
        """The field's text, null where it has none; arrays in arrays are opened three deep."""
        return inner(f"$.{name}", F.col(f"_e.t.{name}"), 3)

    confidence = F.coalesce(text("confidence").try_cast("double"), F.lit(DEFAULT_CONFIDENCE))
    out = rows.select(*keep, F.col("pos").cast("long").alias("pos"), category(F.coalesce(text("category"), F.lit("fact"))).alias("category"), F.coalesce(text("key"), F.lit("")).alias("key_text"), F.coalesce(text("value"), F.lit("")).alias("value_text"), confidence.alias("confidence"))
    return out.filter((F.col("key_text") != "") & (F.col("value_text") != "") & (F.col("confidence") >= LEAST_CONFIDENCE) & ~F.isnan("confidence"))


def parsed(arguments: Column, position: int = 0) -> Column:
    """A struct of what tool arguments hold, read once: failure (what parsing says of text that is no JSON object, else null), kind and raw (type and text of the argument, null where there is none)."""

    def read(text: Column) -> Column:
        def facts(v: Column) -> Column:
            whole = _kind(v)
            java = F.coalesce(F.element_at(_java(), whole), F.lit("java.lang.String"))
            shown = F.when(whole.isin("OBJECT", "ARRAY"), F.to_json(v)).when(v.isNull(), F.coalesce(arguments, F.lit("null"))).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("null")))
            wrong = F.concat(F.lit("Value "), shown, F.lit(" of type "), java, F.lit(" cannot be converted to JSONObject"))
            blank = F.coalesce(F.size(F.filter(F.regexp_extract_all(arguments, F.lit(_PIECES), F.lit(0)), lambda p: ~p.rlike(_SKIPPED))) == 0, F.lit(False))
            ended = F.concat(F.lit("End of input at character "), F.length(arguments).cast("string"), F.lit(" of "), arguments)
            failure = F.when(F.coalesce(whole != "OBJECT", F.lit(True)), F.when(blank, ended).otherwise(wrong))
            at = F.try_variant_get(v, f"$.arg{position}", "variant")
            kind = _kind(at)
            raw = (
                F.when(kind == "VOID", F.lit("null"))
                .when(kind.isin("OBJECT", "ARRAY"), F.get_json_object(text, f"$.arg{position}"))
                .when(kind.isin("DECIMAL", "DOUBLE"), F.try_variant_get(at, "$", "double").cast("string"))
                .otherwise(F.try_variant_get(at, "$", "string"))
            )
            return F.struct(failure.alias("failure"), kind.alias("kind"), F.when(failure.isNull(), raw).alias("raw"))

        return let(F.try_parse_json(text), facts)

    return let(strict(arguments), read)


def _java() -> Column:
    return F.create_map(*[F.lit(x) for kv in JAVA_TYPES.items() for x in kv])


def bool_argument(given: Column) -> Column:
    """Of a boolean, or of the text true or false in any case; null for all else, numbers too. given: of parsed()."""
    low = F.lower(given["raw"])
    return F.when(given["kind"].isin("BOOLEAN", "STRING") & low.isin("true", "false"), low == "true")


def int_argument(given: Column) -> Column:
    """Of a number or a text that reads as one: fractions are cut off, what is too large becomes the largest; whole numbers wrap at 32 bits."""
    kind, raw = given["kind"], given["raw"]
    low = raw.try_cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    wrapped = F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")
    real = raw.try_cast("double")
    cut = F.when(F.isnan(real), 0).when(real.isNotNull(), F.greatest(F.least(real, F.lit(2.0**31 - 1)), F.lit(-(2.0**31)))).cast("int")
    return F.when(kind == "BIGINT", wrapped).when(kind.isin("STRING", "DECIMAL", "DOUBLE"), cut)


def mistyped(given: Column, wanted: Column, position: int = 0) -> Column:
    """What coercing says of an argument that is no wanted (boolean or int)."""
    kind, raw = given["kind"], given["raw"]
    named = F.when((kind == "BIGINT") & raw.try_cast("int").isNull(), F.lit("java.lang.Long")).otherwise(F.element_at(_java(), kind))
    return F.concat(F.lit("Value "), raw, F.lit(f" at arg{position} of type "), named, F.lit(" cannot be converted to "), wanted)


def missing_argument(given: Column, method: Column, position: int = 0) -> Column:
    """The error text if the argument isn't there, else null."""
    return F.when(given["raw"].isNull(), F.concat(F.lit(f"缺少参数: arg{position} (方法: "), method, F.lit(")")))


def speed(status: Column) -> Column:
    """Of a status text; 0 if it can't be read, so that a guard lets pass what it can't judge."""
    return F.coalesce(F.get_json_object(status, "$.车速").try_cast("int"), F.lit(0))


def scene(response: Column) -> Column:
    """A struct of name and description; a response that can't be read is the scene 其他 with the text as description."""
    name, text = F.get_json_object(response, "$.场景名称"), F.get_json_object(response, "$.场景描述")
    return F.struct(F.coalesce(name, F.lit("其他")).alias("name"), F.when(name.isNull(), response).otherwise(F.coalesce(text, F.lit(""))).alias("description"))


def scene_json(name: Column, description: Column) -> Column:
    return F.to_json(F.struct(name.alias("场景名称"), description.alias("场景描述")))
