"""Dependency manifests: inventory, versions and unpinned dependencies.

One manifest is one expression over its text, so what a file declares is a projection
and an explode, without a shuffle:

requirements.txt  name, extras dropped, version after `==`; another operator also
                  counts as a version unless `strict`
package.json      dependencies, dev, peer and optional dependencies; '', '*' and 'latest' are
                  no version
go.mod            require lines and require blocks
Cargo.toml        [dependencies], [dev-dependencies] and [build-dependencies], also of a
                  [target]: `name = "v"` or `version = "v"`; tables like [dependencies.name]
pom.xml           every <dependency> that is not only managed, named group:artifact; its version
                  may be managed by the file, and may name properties of the file

A pom may leave versions and properties to a parent. `inventory_dependencies` looks them up in
the poms of the folders above, the nearest first, by a join on (job, folder); only folders whose
own pom leaves something open take part. A version that no pom of the tree
tells is empty there. The one-pass scan sees one file at a time: a property that the file does
not define counts as a version there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from siftmark.functions.text import let
from siftmark.plans.shared import materialise

# Fixed values of the finding for a dependency without a version.
UNPINNED = {
    "rule_id": "DEP-001", "name": "Unpinned dependency", "category": "compliance", "severity": "medium",
    "message": "Unpinned dependency: ", "fix": "Pin to an exact version for reproducible builds.",
}
_DEP = "array<struct<ecosystem:string,name:string,version:string>>"
_NPM_SECTIONS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
_NPM = ", ".join(f"{name} map<string,string>" for name in _NPM_SECTIONS)
_PAIR = "array<struct<name:string,value:string>>"
_ROUNDS = 3  # properties may name properties, this deep


def _dep(ecosystem: str, name: Column, version: Column) -> Column:
    return F.struct(F.lit(ecosystem).alias("ecosystem"), name.alias("name"), version.alias("version"))


def _all(text: Column, regex: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(group))


def _named(deps: Column) -> Column:
    return F.filter(deps, lambda d: d["name"] != "")


def _requirements(text: Column, strict: bool) -> Column:
    exact = r"==[ \t]*([^\s;,]+)"
    version = exact if strict else r"(?:===?|~=|!=|>=|<=|>|<)[ \t]*([^\s;,]+)"

    def parse(line):
        bare = F.trim(F.regexp_replace(line, r"#.*", ""))
        name = F.regexp_extract(bare, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
        pinned = F.regexp_extract(bare, exact, 1)
        any_version = F.regexp_extract(bare, version, 1)
        return _dep("pypi", name, F.when(pinned != "", pinned).otherwise(any_version))

    return _named(F.transform(F.split(text, r"\r?\n"), parse))


def _package_json(text: Column) -> Column:
    none = F.array().cast("array<struct<key:string,value:string>>")
    # The text is parsed once for all sections.
    both = let(F.from_json(text, _NPM), lambda doc: F.concat(*[F.coalesce(F.map_entries(doc[k]), none) for k in _NPM_SECTIONS]))

    def parse(e):
        version = F.trim(F.coalesce(e["value"], F.lit("")))
        return _dep("npm", e["key"], F.when(version.isin("*", "latest"), "").otherwise(version))

    return F.transform(both, parse)


def _go_mod(text: Column) -> Column:
    bare = F.regexp_replace(text, r"//[^\n]*", "")
    single = _all(bare, r"(?m)^[ \t]*require[ \t]+([^\s(][^\r\n]*)")
    blocks = _all(bare, r"(?ms)^[ \t]*require[ \t]*\((.*?)^[ \t]*\)")
    inside = F.flatten(F.transform(blocks, lambda b: F.split(b, r"\r?\n")))

    def parse(line):
        return _dep("go", F.regexp_extract(line, r"^\s*(\S+)", 1), F.regexp_extract(line, r"^\s*\S+\s+(\S+)", 1))

    return _named(F.transform(F.concat(single, inside), parse))


_CARGO = r"(?:target\.[^\]\n]+\.)?(?:dev-|build-)?dependencies"
_QUOTED = r"""["']([^"']*)["']"""


def _cargo(text: Column) -> Column:
    behind = r"[^\n]*(?:\n(.*?))?(?=^[ \t]*\[|\z)"
    sections = _all(text, rf"(?ms)^[ \t]*\[{_CARGO}\]{behind}")
    lines = F.flatten(F.transform(sections, lambda s: F.split(s, r"\r?\n")))
    pinned = lambda v: F.when(v == "*", "").otherwise(v)

    def parse(line):
        bare = F.regexp_replace(line, r"^\s*#.*", "")
        value = F.regexp_extract(bare, r"=\s*(.*)$", 1)
        plain = F.regexp_extract(value, "^" + _QUOTED, 1)
        table = F.regexp_extract(value, r"^\{.*?\bversion\s*=\s*" + _QUOTED, 1)
        name = F.regexp_extract(bare, r"""^\s*["']?([A-Za-z0-9_-]+)["']?\s*=""", 1)
        return _dep("cargo", name, pinned(F.when(plain != "", plain).otherwise(table)))

    # A table of one dependency: its name stands in the header, its version on a line of its own.
    header = rf"""(?ms)^[ \t]*\[{_CARGO}\.["']?([A-Za-z0-9_-]+)["']?\]{behind}"""
    tables = F.zip_with(_all(text, header, 1), _all(text, header, 2), lambda name, body: _dep(
        "cargo", name, pinned(F.regexp_extract(body, r"(?m)^[ \t]*version[ \t]*=[ \t]*" + _QUOTED, 1))))
    return F.concat(_named(F.transform(lines, parse)), tables)


_MANAGED = r"(?s)<dependencyManagement>.*?</dependencyManagement>"


def _pom_text(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def _pom_deps(bare: Column) -> Column:
    """array<struct<name,value>>: the dependencies of a piece of a pom with their versions as written."""
    found = _all(bare, r"(?s)<dependency>(.*?)</dependency>")
    tag = lambda d, name: F.regexp_extract(d, rf"<{name}>\s*([^<]*?)\s*</{name}>", 1)
    return F.transform(found, lambda d: F.struct(
        F.concat(tag(d, "groupId"), F.lit(":"), tag(d, "artifactId")).alias("name"), tag(d, "version").alias("value")))


def _pom_managed(bare: Column) -> Column:
    return _pom_deps(F.array_join(_all(bare, f"({_MANAGED})"), ""))


def _pom_properties(bare: Column) -> Column:
    """array<struct<name,value>>: the properties of a pom, its own version and that of its parent among them."""
    block = F.array_join(_all(bare, r"(?s)<properties>(.*?)</properties>"), "")
    entry = r"<([A-Za-z0-9_.-]+)>\s*([^<]*?)\s*</\1>"
    named = F.zip_with(_all(block, entry, 1), _all(block, entry, 2), lambda n, v: F.struct(n.alias("name"), v.alias("value")))
    version = r"<version>\s*([^<]*?)\s*</version>"
    parent = F.regexp_extract(F.regexp_extract(bare, r"(?s)<parent>(.*?)</parent>", 1), version, 1)
    blocks = "|".join(f"<{b}>.*?</{b}>" for b in ("parent", "dependencyManagement", "dependencies", "build", "profiles", "properties"))
    stated = F.regexp_extract(F.regexp_replace(bare, f"(?s){blocks}", ""), version, 1)
    own = F.when(stated != "", stated).otherwise(parent)
    more = {"project.version": own, "version": own, "project.parent.version": parent}
    known = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in more.items()])
    return F.concat(named, F.filter(known, lambda p: p["value"] != ""))


def _lookup(pairs: Column, name: Column) -> Column:
    return F.get(F.filter(pairs, lambda p: p["name"] == name), 0)["value"]


def _placeholder(version: Column) -> Column:
    """The first property that a version names, '' if it names none."""
    return F.regexp_extract(version, r"\$\{([^}]+)\}", 1)


def _put(version: Column, name: Column, value: Column) -> Column:
    return F.replace(version, F.concat(F.lit("${"), name, F.lit("}")), value)


def _expand(version: Column, properties: Column) -> Column:
    """The version with the properties it names; what is not among them stays as it is."""
    put = lambda v: F.coalesce(_put(v, _placeholder(v), _lookup(properties, _placeholder(v))), v)
    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), version, lambda v, _: put(v))


def _pom(text: Column) -> Column:
    def parse(bare):
        def resolve(parts):
            def one(d):
                managed = F.when(d["value"] == "", F.coalesce(_lookup(parts["managed"], d["name"]), F.lit(""))).otherwise(d["value"])
                return _dep("maven", d["name"], _expand(managed, parts["properties"]))

            return F.transform(parts["deps"], one)

        own = F.regexp_replace(bare, _MANAGED, "")
        parts = F.struct(_pom_deps(own).alias("deps"), _pom_managed(bare).alias("managed"), _pom_properties(bare).alias("properties"))
        return let(parts, resolve)

    return let(_pom_text(text), parse)


def manifest_deps(path: Column, content: Column, strict: bool = False) -> Column:
    """array<struct<ecosystem,name,version>> of one file; null when it is no manifest."""
    name = F.substring_index(path, "/", -1)
    return (
        F.when(name == "requirements.txt", _requirements(content, strict).cast(_DEP))
        .when(name == "package.json", _package_json(content).cast(_DEP))
        .when(name == "go.mod", _go_mod(content).cast(_DEP))
        .when(name == "Cargo.toml", _cargo(content).cast(_DEP))
        .when(name == "pom.xml", _pom(content).cast(_DEP))
    )


MANIFESTS = ["requirements.txt", "package.json", "go.mod", "Cargo.toml", "pom.xml"]


def is_manifest(path: Column) -> Column:
    """A test on the path alone, so that other contents are never touched."""
    return reduce(lambda a, b: a | b, [path.endswith(m) for m in MANIFESTS])


def declared_dependencies(files: DataFrame, strict: bool = False) -> DataFrame:
    """deps(job_id, path, ecosystem, name, version) as far as each file tells, one row per declared dependency."""
    found = files.where(is_manifest(F.col("path"))).select(
        "job_id", "path", F.explode(manifest_deps(F.col("path"), F.col("content"), strict)).alias("d")
    )
    return found.select("job_id", "path", "d.ecosystem", "d.name", "d.version")


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(?:(.*)/)?[^/]*$", 1)


def _above(folder: Column) -> Column:
    """The folder and all above it, from the file's own up to the root ''."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def _told_above(poms: DataFrame, asked: DataFrame) -> DataFrame:
    """(_job, _folder, managed, properties) for the folders asked: what the poms there and above tell, the nearest first.

    A folder has as many poms above it as it has levels, so the lists are bounded by the poms' own.
    """
    places = asked.select("job_id", "folder").distinct().withColumn("at", F.explode(_above(F.col("folder"))))
    known = poms.select(
        F.col("job_id").alias("_job"), F.col("folder").alias("_at"),
        F.struct(F.length("folder").alias("depth"), _pom_managed(F.col("bare")).alias("managed"), _pom_properties(F.col("bare")).alias("properties")).alias("told"),
    )
    found = places.join(known, F.col("job_id").eqNullSafe(F.col("_job")) & (F.col("at") == F.col("_at")))
    lists = found.groupBy("job_id", "folder").agg(F.sort_array(F.collect_list("told"), asc=False).alias("told"))
    of = lambda name: F.flatten(F.transform("told", lambda t: t[name])).alias(name)
    return lists.select(F.col("job_id").alias("_job"), F.col("folder").alias("_folder"), of("managed"), of("properties"))


def inventory_dependencies(files: DataFrame, strict: bool = False) -> DataFrame:
    """deps(job_id, path, ecosystem, name, version), one row per declared dependency; versions that a pom leaves to
    the poms above are looked up there. What is declared is written to a table while the query is built."""
    declared = materialise(declared_dependencies(files, strict).withColumn("folder", _folder(F.col("path"))), "declared")
    version = F.col("version")
    is_open = (F.col("ecosystem") == "maven") & ((version == "") | (_placeholder(version) != ""))
    columns = ["job_id", "path", "ecosystem", "name"]
    left = declared.where(is_open)
    if left.isEmpty():
        return declared.select(*columns, "version")
    poms = files.where(F.substring_index("path", "/", -1) == "pom.xml")
    poms = poms.select("job_id", _folder(F.col("path")).alias("folder"), _pom_text(F.col("content")).alias("bare"))
    told = _told_above(poms, left)
    same = F.col("job_id").eqNullSafe(F.col("_job")) & (F.col("folder") == F.col("_folder")) & is_open
    joined = declared.join(told, same, "left")
    stated = F.when(version == "", F.coalesce(_lookup(F.col("managed"), F.col("name")), F.lit(""))).otherwise(version)
    known = let(_expand(stated, F.col("properties")), lambda v: F.when(_placeholder(v) != "", "").otherwise(v))
    return joined.select(*columns, F.when(is_open, known).otherwise(version).alias("version"))


def manifest_rejects(files: DataFrame) -> DataFrame:
    """(job_id, path, reason) of the manifests that cannot be read, or only in part."""
    path, content = F.col("path"), F.col("content")
    name = F.substring_index(path, "/", -1)
    broken = F.from_json(content, f"{_NPM}, _bad string", {"columnNameOfCorruptRecord": "_bad"})["_bad"]
    count = lambda regex: F.size(_all(content, regex, 0))
    reason = (
        F.when(content.isNull(), "no text")
        .when((name == "package.json") & (broken.isNotNull() | ~content.rlike(r"\A\s*\{")), "no JSON object")
        .when((name == "pom.xml") & ~content.rlike(r"(?s)<project[\s>].*</project>"), "no whole project element")
        .when((name == "go.mod") & (count(r"(?m)^[ \t]*require[ \t]*\(") > count(r"(?ms)^[ \t]*require[ \t]*\(.*?^[ \t]*\)")), "open require block")
        .when((name == "Cargo.toml") & content.rlike(r"(?m)^[ \t]*\[[^\]\r\n]*$"), "open section header")
    )
    found = files.where(is_manifest(path) & name.isin(MANIFESTS)).select("job_id", "path", reason.alias("reason"))
    return found.where("reason IS NOT NULL")


def scan_unpinned(deps: DataFrame) -> DataFrame:
    """One finding per dependency without a version, in the shape of the other findings."""
    lit = lambda name: F.lit(UNPINNED[name])
    return deps.where("version = ''").select(
        "job_id", lit("rule_id").alias("rule_id"), lit("name").alias("rule_name"),
        lit("category").alias("category"), lit("severity").alias("severity"), F.col("path").alias("file"),
        F.lit(1).alias("line"), F.lit(1).alias("column"), F.concat(lit("message"), "name").alias("message"),
        F.lit("").alias("snippet"), lit("fix").alias("fix_suggestion"), "ecosystem", "name",
    )
