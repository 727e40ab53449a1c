"""Text units of nested game documents: (file, content) rows to groups and units.

Documents are JSON text.  Database files and the system file are projected with
built-in functions; event lists are runs of commands, found with windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Text fields of the database files.
DATABASE = {
    "Actors.json": ("name", "nickname", "profile"),
    "Armors.json": ("name", "description"),
    "Classes.json": ("name",),
    "Enemies.json": ("name",),
    "Items.json": ("name", "description"),
    "Skills.json": ("name", "description", "message1", "message2"),
    "States.json": ("name", "message1", "message2", "message3", "message4"),
    "Weapons.json": ("name", "description"),
}
_FIELDS = sorted({f for fs in DATABASE.values() for f in fs})
_COMMAND = "struct<code: int, indent: int, parameters: array<string>>"


def database_units(docs: DataFrame) -> DataFrame:
    """file, entry, field, text of the database files' non-blank fields; null entries are skipped."""
    schema = "array<struct<" + ", ".join(f"{f}: string" for f in _FIELDS) + ">>"
    wanted = F.array(*[F.struct(F.lit(f).alias("file"), F.lit(x).alias("field"), F.lit(i).alias("place")) for f, fs in DATABASE.items() for i, x in enumerate(fs)])
    rows = docs.filter(F.col("file").isin(*DATABASE)).select("file", F.posexplode(F.from_json("content", schema)).alias("entry", "e")).filter("e is not null")
    fields = rows.select("file", "entry", "e", F.explode(F.filter(wanted, lambda w: w["file"] == F.col("file"))).alias("w"))
    value = F.coalesce(*[F.when(F.col("w.field") == f, F.col("e")[f]) for f in _FIELDS])
    return fields.select("file", "entry", F.col("w.field").alias("field"), F.col("w.place").alias("place"), value.alias("text")).filter(F.trim("text") != "")


def system_units(docs: DataFrame) -> DataFrame:
    """field, place, text of the system file: title and currency, terms' arrays, messages, type names."""
    schema = "struct<gameTitle: string, currencyUnit: string, terms: struct<basic: array<string>, commands: array<string>, params: array<string>, messages: map<string, string>>, elements: array<string>, skillTypes: array<string>, weaponTypes: array<string>, armorTypes: array<string>, equipTypes: array<string>>"
    s = docs.filter("file = 'System.json'").select(F.from_json("content", schema).alias("s")).select("s.*")
    parts = [s.select(F.lit(n).alias("field"), F.lit("0").alias("place"), F.col(n).alias("text")) for n in ("gameTitle", "currencyUnit")]
    arrays = {**{f"terms.{n}": f"terms.{n}" for n in ("basic", "commands", "params")}, **{n: n for n in ("elements", "skillTypes", "weaponTypes", "armorTypes", "equipTypes")}}
    parts += [s.select(F.lit(n).alias("field"), F.posexplode(F.col(c)).alias("p", "text")).select("field", F.col("p").cast("string").alias("place"), "text") for n, c in arrays.items()]
    parts.append(s.select(F.lit("terms.messages").alias("field"), F.explode("terms.messages").alias("place", "text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("text is not null and trim(text) != ''")


def event_commands(docs: DataFrame) -> DataFrame:
    """file, event, page, i, code, indent, parameters of maps (Map*.json), common events and troops."""
    page = f"struct<list: array<{_COMMAND}>>"
    maps = docs.filter(F.col("file").rlike(r"^Map[0-9]+\.json$")).select("file", F.from_json("content", f"struct<events: array<struct<id: int, pages: array<{page}>>>>").alias("m")).select("file", F.explode("m.events").alias("e")).filter("e is not null").select("file", F.col("e.id").alias("event"), F.posexplode("e.pages").alias("page", "p"))
    common = docs.filter("file = 'CommonEvents.json'").select("file", F.explode(F.from_json("content", f"array<struct<id: int, list: array<{_COMMAND}>>>")).alias("e")).filter("e is not null").select("file", F.col("e.id").alias("event"), F.lit(0).alias("page"), F.struct(F.col("e.list").alias("list")).alias("p"))
    troops = docs.filter("file = 'Troops.json'").select("file", F.explode(F.from_json("content", f"array<struct<id: int, pages: array<{page}>>>")).alias("e")).filter("e is not null").select("file", F.col("e.id").alias("event"), F.posexplode("e.pages").alias("page", "p"))
    every = maps.unionByName(common).unionByName(troops)
    return every.select("file", "event", "page", F.posexplode("p.list").alias("i", "c")).select("file", "event", "page", "i", "c.code", "c.indent", "c.parameters")


_LIST = ["file", "event", "page"]


def text_runs(commands: DataFrame, head: int, line: int, kind: str) -> DataFrame:
    """A head command and the lines right after it as one body: file, event, page, i, kind, head_parameters, lines."""
    w = W.partitionBy(*_LIST).orderBy("i")
    run = F.sum((F.col("code") != line).cast("int")).over(w)
    marked = commands.withColumn("run", run)
    body = marked.groupBy(*_LIST, "run").agg(F.min("i").alias("i"), F.min_by("code", "i").alias("first"), F.min_by("parameters", "i").alias("head_parameters"), F.array_sort(F.collect_list(F.when(F.col("code") == line, F.struct("i", F.get("parameters", F.lit(0)).alias("t"))))).alias("b"))
    return body.filter(F.col("first") == head).select(*_LIST, "i", F.lit(kind).alias("kind"), "head_parameters", F.transform("b", lambda x: x["t"]).alias("lines"))


def orphans(commands: DataFrame) -> DataFrame:
    """Line commands (401, 405) that don't follow their head or one another."""
    w = W.partitionBy(*_LIST).orderBy("i")
    before = F.lag("code").over(w)
    marked = commands.withColumn("before", before)
    lost = ((F.col("code") == 401) & ~F.coalesce(F.col("before").isin(101, 401), F.lit(False))) | ((F.col("code") == 405) & ~F.coalesce(F.col("before").isin(105, 405), F.lit(False)))
    return marked.filter(lost).select(*_LIST, "i", "code")


def choices(commands: DataFrame) -> DataFrame:
    """Choices (102) with their branches (402) at the same indent up to the end (404): file, event, page, i, options, branches, closed."""
    w = W.partitionBy(*_LIST, "indent").orderBy("i")
    opened = F.sum((F.col("code") == 102).cast("int")).over(w)
    near = commands.filter(F.col("code").isin(102, 402, 404)).withColumn("choice", opened).filter("choice > 0")
    found = near.groupBy(*_LIST, "indent", "choice").agg(
        F.min(F.when(F.col("code") == 102, F.col("i"))).alias("i"),
        F.min(F.when(F.col("code") == 102, F.get("parameters", F.lit(0)))).alias("o"),
        F.count_if(F.col("code") == 402).alias("branches"),
        (F.max_by("code", "i") == 404).alias("closed"),
    )
    return found.select(*_LIST, "i", F.from_json("o", "array<string>").alias("options"), "branches", "closed")


def speakers(bodies: DataFrame) -> DataFrame:
    """Dialogue bodies with the speaker of the head's fifth parameter, where it isn't blank."""
    name = F.get("head_parameters", F.lit(4))
    return bodies.withColumn("speaker", F.when(F.trim(name) != "", name))


def inline_speakers(bodies: DataFrame, pattern: str) -> DataFrame:
    """Dialogue bodies whose first line holds a speaker (group 1 of the pattern), with what is left of it."""
    first = F.get("lines", F.lit(0))
    return bodies.withColumn("speaker", F.nullif(F.regexp_extract(first, pattern, 1), F.lit(""))).withColumn("first_line", F.regexp_replace(first, pattern, ""))


def plugin_array(text: DataFrame) -> DataFrame:
    """prefix, plugins, suffix of a script whose one array literal lists plugins."""
    envelope = r"(?s)^(.*?=\s*)(\[.*\])(\s*;?\s*)$"
    return text.select(
        F.regexp_extract("content", envelope, 1).alias("prefix"),
        F.from_json(F.regexp_extract("content", envelope, 2), "array<struct<name: string, status: boolean, parameters: map<string, string>>>").alias("plugins"),
        F.regexp_extract("content", envelope, 3).alias("suffix"),
    )


def plugin_parameters(plugins: DataFrame, name: str) -> DataFrame:
    """parameter, value of an active plugin of exactly that name."""
    return plugins.select(F.explode("plugins").alias("p")).filter((F.col("p.name") == name) & F.col("p.status")).select(F.explode("p.parameters").alias("parameter", "value"))


def actor_changes(commands: DataFrame) -> DataFrame:
    """Commands that change an actor's name (320), nickname (324) or profile (325)."""
    field = F.when(F.col("code") == 320, "name").when(F.col("code") == 324, "nickname").when(F.col("code") == 325, "profile")
    return commands.withColumn("field", field).filter("field is not null").select(*_LIST, "i", "field", F.get("parameters", F.lit(1)).alias("text"))


def command_rule(commands: DataFrame, code: int, parameter: int) -> DataFrame:
    """One parameter of each command with a code."""
    return commands.filter(F.col("code") == code).select(*_LIST, "i", F.get("parameters", F.lit(parameter)).alias("text")).filter("text is not null")


def resource_kind(path: Column) -> Column:
    """image, audio, video, data or null by a path's ending."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9_]+)$", 1))
    return F.when(ending.isin("png", "jpg", "jpeg", "webp", "png_", "rpgmvp"), "image").when(ending.isin("ogg", "m4a", "wav", "mp3", "ogg_", "rpgmvo", "rpgmvm"), "audio").when(ending.isin("webm", "mp4"), "video").when(ending.isin("json", "js", "csv", "txt"), "data")
