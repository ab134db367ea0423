"""Column functions over text: tokens, canonical text, slugs, URLs, bands and junk terms."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Common words that alone make no query.
STOPWORDS = ("a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits; none of a null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def squeezed(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def canonical(title: Column, description: Column, tags: Column) -> Column:
    """The parts that are not blank, joined by a dash; tags by commas."""
    kept = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")
    return F.concat_ws(" — ", squeezed(title), squeezed(description), squeezed(F.array_join(kept, ", ")))


def slug(term: Column, most: int = 60) -> Column:
    """What is not a letter or digit becomes a dash; 'term' if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(term), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(plain, 1, most), F.lit("")), F.lit("term"))


def url_decoded(text: Column) -> Column:
    """Percent-decoding that leaves a plus, and a percent sign without two hex digits after it, as they are; bytes that are no UTF-8
    become replacement characters."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B"))


def orientation(width: Column, height: Column) -> Column:
    w, h = width.try_cast("double"), height.try_cast("double")
    return F.when(w.isNull() | h.isNull(), None).when(w == h, "square").when(h > w, "portrait").otherwise("landscape")


def person(first: Column, last: Column, username: Column) -> Column:
    """First and last name, trimmed; the user name if both are blank."""
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws(" ", part(first), part(last)), F.lit("")), username)


def band(match: Column) -> Column:
    return F.when(match >= 1000, "head").when(match >= 100, "torso").when(match >= 2, "tail")


def is_junk(term: Column) -> Column:
    """A URL, no or too many tokens, only digits, no word of two letters, or only common words."""
    odd = lambda t: (
        ~F.size(t).between(1, 6)
        | F.forall(t, lambda x: x.rlike("^[0-9]+$"))
        | ~F.exists(t, lambda x: x.rlike("^[a-z]{2,}$"))
        | F.forall(t, lambda x: x.isin(*STOPWORDS))
    )
    return F.lower(term).rlike("http|www") | F.get(F.transform(F.array(tokens(term)), odd), F.lit(0))  # tokens are found once


def language(text: Column) -> Column:
    return F.when(text.rlike("[\\u4e00-\\u9fff]"), "zh").otherwise("en")


def query_text(coarse: Column, terms: Column) -> Column:
    """The coarse query if it is not blank, else the terms that are not blank."""
    kept = F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: t != "")
    return F.coalesce(F.nullif(F.trim(coarse), F.lit("")), F.array_join(kept, " "))


def page_url(base: str, name: Column, key: Column) -> Column:
    return F.concat(F.lit(base), F.coalesce(F.nullif(name, F.lit("")), F.lit("video")), F.lit("-"), key.cast("string"), F.lit("/"))


def tag_texts(tags: Column) -> Column:
    """Trimmed tag texts of a JSON array of strings and objects (name, else search_term), blanks dropped, order kept."""
    texts = F.transform(F.from_json(tags, "array<string>"), lambda t: F.trim(F.when(t.startswith("{"), F.coalesce(F.nullif(F.get_json_object(t, "$.name"), F.lit("")), F.get_json_object(t, "$.search_term"))).otherwise(t)))
    return F.filter(texts, lambda t: t.isNotNull() & (t != ""))


def repaired_tags(tags: Column) -> Column:
    """Tags of which some were stored as objects: their names, other objects dropped; left alone without any."""
    named = F.transform(tags, lambda t: F.when(t.startswith("{"), F.get_json_object(t, "$.name")).otherwise(t))
    return F.when(F.exists(tags, lambda t: t.startswith("{")), F.filter(named, lambda t: t.isNotNull() & (t != ""))).otherwise(tags)


@F.arrow_udf(ArrayType(StringType()))
def _short_numbers(lists: pa.Array) -> pa.Array:
    return pa.array([None if xs is None else [None if x is None else f"{x:.6g}" for x in xs] for xs in lists.to_pylist()], pa.list_(pa.string()))


def short_numbers(v: Column) -> Column:
    """The numbers of an array with six significant digits, without zeros at the end. They are rounded as C's printf does, by the
    whole binary value, ties to even; Java's Formatter rounds the shortest decimal form, and ties up."""
    return _short_numbers(v.cast("array<double>"))


def short_number(x: Column) -> Column:
    return F.get(short_numbers(F.array(x)), F.lit(0))


def vector_literal(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(short_numbers(v), ","), F.lit("]"))


def sparse_literal(weights: Column, size: int) -> Column:
    """``{number:weight,...}/size`` of an array of structs (number, weight), in the order of the numbers."""
    order = F.array_sort(weights)
    items = F.zip_with(order, short_numbers(F.transform(order, lambda x: x["weight"])), lambda x, digits: F.concat(x["number"].cast("string"), F.lit(":"), digits))
    return F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}/" + str(size)))


def parsed_vector(text: Column) -> Column:
    """Null of an empty text or list."""
    v = F.from_json(text, "array<float>")
    return F.when(F.size(v) > 0, v)


def graded(answer: Column) -> Column:
    """grade and reason of an answer that is a JSON object or holds some: those of the first object with a grade of 0 to 3, a number
    or digits in quotes; without one, null and the beginning of the answer."""
    objects = F.concat(F.array(answer), F.regexp_extract_all(answer, F.lit(r"\{[^}]*\}"), F.lit(0)))
    digits = lambda c: F.trim(F.get_json_object(c, "$.grade"))
    good = F.filter(objects, lambda c: F.try_parse_json(c).isNotNull() & F.coalesce(digits(c).rlike("^0*[0-3]$"), F.lit(False)))
    first = F.get(good, F.lit(0))
    told = F.struct(digits(first).cast("int").alias("grade"), F.substring(F.coalesce(F.get_json_object(first, "$.reason"), F.lit("")), 1, 500).alias("reason"))
    return F.when(F.size(good) > 0, told).otherwise(F.struct(F.lit(None).cast("int").alias("grade"), F.substring(F.coalesce(answer, F.lit("")), 1, 200).alias("reason")))


def grade(answer: Column) -> Column:
    return graded(answer)["grade"]


def page_attributes(payload: Column) -> Column:
    """The attribute object (JSON text) of a page's data, if it is a medium's and has an id; else null."""
    found = F.get_json_object(payload, "$.pageProps.medium.attributes")
    return F.when(found.startswith("{") & has_id(found), found)


def has_id(attributes: Column) -> Column:
    """Whether a JSON text is an object with the key id, whatever its value."""
    return F.coalesce(attributes.startswith("{") & F.array_contains(F.json_object_keys(attributes), "id"), F.lit(False))


def json_text(value: Column) -> Column:
    """A map, array or struct as JSON text, null as null."""
    return F.to_json(value)


def file_safe(name: str) -> str:
    """A version's name as part of a file's."""
    return name.replace("@", "_at_").replace("/", "_")


# How a caption's answer begins, and how an echo of the task does.
ANSWER_MARKS = ("main subject:", "subject:", "setting:")
ECHO_MARKS = ("task:", "constraints:", "requirements:", "required elements:", "format:")


def caption(parts: Column) -> Column:
    """A model's answer (its parts, as an array) as one line: bullets go, and an echo of the task before the answer.

    With an echo, the text begins at the first answer mark; without such a mark, the lines of the echo go.
    """
    ends = r"^\s+|\s+$"
    raw = F.regexp_replace(F.array_join(F.filter(parts, lambda p: p != ""), " "), ends, "")
    plain = F.transform(F.split(raw, r"\r\n|\n|\r"), lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, ends, ""), r"^[*\-# ]+", ""), ends, ""))
    lines = F.filter(plain, lambda x: x != "")
    echo = lambda x: F.lower(x).rlike("^(" + "|".join(ECHO_MARKS) + ")")
    start = F.array_position(F.transform(lines, lambda x: F.lower(x).rlike("^(" + "|".join(ANSWER_MARKS) + ")")), True).cast("int")
    kept = F.when(~F.exists(lines, echo), lines).when(start > 0, F.slice(lines, F.greatest(start, F.lit(1)), F.size(lines))).otherwise(F.filter(lines, lambda x: ~echo(x)))
    return F.array_join(kept, " ")


def url_quoted(text: Column) -> Column:
    """Percent-encoding of all but letters, digits and ``_.-~``; a space is %20."""
    form = F.url_encode(text)  # as forms have it
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def is_clean(term: Column) -> Column:
    """Lower-case words of 3 to 41 characters in all, which may be searched for again."""
    return term.rlike("^[a-z][a-z ]{2,40}$")


def judge_version(model: Column, prompt: Column) -> Column:
    return F.concat(model, F.lit("@"), prompt)


def crossed(cursor: Column, marker: Column) -> Column:
    """Whether a cursor has come down to the marker: as times if both are, else as text."""
    a, b = F.try_to_timestamp(cursor), F.try_to_timestamp(marker)
    return F.when(a.isNotNull() & b.isNotNull(), a <= b).otherwise(cursor <= marker)


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def media_rows(rows: DataFrame, source: str, record: str = "record") -> DataFrame:
    """The 19 columns of media items from their attributes (``record``: JSON text), each parsed once into a VARIANT that missing
    and odd fields do not break. A text that is no JSON, or has a key twice, gives an item of nulls; fields of another kind are
    null, and numbers in quotes count as numbers."""
    at = lambda path, kind="string": F.try_variant_get("v", f"$.{path}", kind)
    number = lambda path, kind: at(path).try_cast(kind).alias(path)
    listed = lambda path: F.schema_of_variant(F.try_variant_get("v", f"$.{path}", "variant")).startswith("ARRAY")
    tag = lambda t: F.trim(F.when(t.startswith("{"), F.coalesce(_some(F.get_json_object(t, "$.name")), F.get_json_object(t, "$.search_term"))).otherwise(t))
    tags = F.filter(F.transform(F.when(listed("tags"), at("tags", "array<string>")), tag), lambda t: t.isNotNull() & (t != ""))
    sizes = F.map_values(at("video.thumbnail", "map<string,string>"))
    single = F.when(F.schema_of_variant(F.try_variant_get("v", "$.video.thumbnail", "variant")) == "STRING", _some(at("video.thumbnail")))
    named = [_some(at(f"video.thumbnail.{size}")) for size in ("large", "medium", "small")]
    picture = F.coalesce(single, *named, F.get(F.filter(sizes, lambda x: x != ""), F.lit(0)), _some(at("video.preview_src")))
    parsed = rows.select(F.col(record).alias("raw"), F.try_parse_json(record).alias("v"))
    return parsed.select(
        at("id").try_cast("long").alias("item_id"), at("slug").alias("slug"), at("title").alias("title"), at("description").alias("description"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
        number("duration", "int"), number("width", "int"), number("height", "int"), number("fps", "double"), number("aspect_ratio", "double"),
        orientation(at("width"), at("height")).alias("orientation"), at("license").alias("license"),
        person(at("user.first_name"), at("user.last_name"), _some(at("user.username"))).alias("user_name"), at("created_at").alias("created_at"),
        F.when(listed("video.video_files"), at("video.video_files")).otherwise("[]").alias("video_files"), picture.alias("thumbnail_url"), at("video.download_link").alias("download_link"),
        F.lit(source).alias("source"), "raw",
    )


def has_uhd(files: Column) -> Column:
    """Whether any rendition (JSON array of objects with width and height) is 3840 pixels or more on its longer side."""
    sizes = F.from_json(files, "array<struct<width:int,height:int>>")
    return F.coalesce(F.exists(sizes, lambda f: F.greatest(f["width"], f["height"]) >= 3840), F.lit(False))
