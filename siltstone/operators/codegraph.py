"""The graph of Python sources: directories, files, classes and functions, what contains and what imports what.

Only reading syntax trees takes Python; names are resolved by joins.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOT = "/"
FACTS = "path string, kind string, name string, start_line int, end_line int, module string, alias string"


def _definitions(node: ast.AST, above: tuple[str, ...], in_class: bool):
    """Classes and functions below a node with their dotted names; a class's own `def __init__` is part of it."""
    for child in ast.iter_child_nodes(node):
        if isinstance(child, ast.ClassDef):
            yield "class", (*above, child.name), child
            yield from _definitions(child, (*above, child.name), True)
        elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
            if in_class and child.name == "__init__" and isinstance(child, ast.FunctionDef):
                continue
            yield "function", (*above, child.name), child
            yield from _definitions(child, (*above, child.name), False)
        else:
            yield from _definitions(child, above, in_class)


def _imports(tree: ast.AST, path: str):
    """(module, name, alias) of each import; name is null for a module or all of one."""
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            yield from ((a.name, None, a.asname) for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            folders = path.split("/")
            base = (folders[: -node.level] if len(folders) >= node.level else []) if node.level else []
            module = ".".join([*base, *([node.module] if node.module else [])])
            if any(a.name == "*" for a in node.names):
                yield module, None, None
            else:
                yield from ((module, a.name, a.asname) for a in node.names)


def _called(node: ast.AST, deep: bool):
    """Simple names of what is called below a node; with not deep, functions and classes defined there keep theirs."""
    for child in ast.iter_child_nodes(node):
        if not deep and isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            continue
        if isinstance(child, ast.Call) and isinstance(child.func, ast.Name | ast.Attribute):
            yield child.func.id if isinstance(child.func, ast.Name) else child.func.attr
        yield from _called(child, deep)


def _uses(kind: str, node: ast.AST):
    """(kind, name): what a class inherits and its own `__init__` calls, or what a function calls."""
    if kind == "function":
        yield from (("invokes", n) for n in _called(node, False))
        return
    yield from (("inherits", b.id if isinstance(b, ast.Name) else b.attr) for b in node.bases if isinstance(b, ast.Name | ast.Attribute))
    own = next((x for x in node.body if isinstance(x, ast.FunctionDef) and x.name == "__init__"), None)
    yield from (("invokes", n) for n in (_called(own, True) if own else ()))


def _visible(found: list[tuple]):
    """(scope, inner) of dotted names, () for the file: what is defined in a scope, and in classes within it."""
    classes = {name for kind, name, _ in found if kind == "class"}
    for _, name, _ in found:
        scope = name[:-1]
        yield scope, name
        while scope in classes:
            scope = scope[:-1]
            yield scope, name


def facts(sources: DataFrame) -> DataFrame:
    """Rows of FACTS for each file of sources (path, text) that ends in .py: kind is file, parsed, class, function, import,
    invokes, inherits (module: the name used) or member (module: what is visible in the scope).

    Lines count from 1. A text that is null or doesn't parse (or nests too deep) gives its file alone.
    """
    names = [x.split()[0] for x in FACTS.split(", ")]

    def rows(path: str, text: str | None):
        yield path, "file", None, None, None, None, None
        try:
            tree = ast.parse(text if text is not None else "\0")
            found = list(_definitions(tree, (), False))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return
        yield path, "parsed", None, None, None, None, None
        for kind, name, node in found:
            yield path, kind, ".".join(name), node.lineno, node.end_lineno, None, None
        for kind, name, node in found:
            for use, called in dict.fromkeys(_uses(kind, node)):
                yield path, use, ".".join(name), None, None, called, None
        for scope, inner in dict.fromkeys(_visible(found)):
            yield path, "member", ".".join(scope), None, None, ".".join(inner), None
        for module, name, alias in _imports(tree, path):
            yield path, "import", name, None, None, module, alias

    def run(batches):
        for batch in batches:
            out = [r for p, t in zip(batch["path"], batch["text"], strict=True) for r in rows(p, t)]
            yield pd.DataFrame(out, columns=names).astype({"start_line": "Int32", "end_line": "Int32"})

    return sources.where("path like '%.py'").select("path", "text").mapInPandas(run, FACTS)


def _folder(path):
    """The folder of a path; ROOT for one at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(F.lit(ROOT))


def _folders(known: DataFrame) -> DataFrame:
    """All folders above the files."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return known.where("kind = 'file' and path like '%/%'").select(F.explode(above).alias("id")).distinct()


def _entity(path="path", name="name"):
    return F.concat_ws(":", path, name)


def nodes(known: DataFrame) -> DataFrame:
    """(id, type, start_line, end_line) from facts(): folders that hold sources, files, classes, functions; of equal ids the last."""
    none = F.lit(None).cast("int")
    top = known.sparkSession.range(1).select(F.lit(ROOT).alias("id"))
    folders = top.unionByName(_folders(known)).select("id", F.lit("directory").alias("type"), none.alias("start_line"), none.alias("end_line"))
    files = known.where("kind = 'file'").select(F.col("path").alias("id"), F.lit("file").alias("type"), none.alias("start_line"), none.alias("end_line"))
    inner = known.where("kind in ('class', 'function')").groupBy(_entity().alias("id")).agg(F.max_by(F.struct("kind", "start_line", "end_line"), "start_line").alias("x"))
    return folders.unionByName(files).unionByName(inner.select("id", F.col("x.kind").alias("type"), "x.start_line", "x.end_line"))


def contains(known: DataFrame) -> DataFrame:
    """(src, dst): folders in folders, files that parse in folders, classes and functions in what they are defined in."""
    folders = _folders(known).select(_folder(F.col("id")).alias("src"), F.col("id").alias("dst"))
    files = known.where("kind = 'parsed'").select(_folder(F.col("path")).alias("src"), F.col("path").alias("dst"))
    above = F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)
    inner = known.where("kind in ('class', 'function')").select(F.when(above == "", F.col("path")).otherwise(F.concat_ws(":", "path", above)).alias("src"), _entity().alias("dst"))
    return folders.unionByName(files).unionByName(inner)


def imports(known: DataFrame) -> DataFrame:
    """(src, dst, alias): files and the files, packages or entities of the sources that they import.

    `from m import x` goes to the module m.x if there is one, else to the entity x of m, else to m; all of m to m.
    A module is m.py, else the package m/__init__.py.
    """
    files = known.where("kind = 'file'").select("path")
    module = F.regexp_replace(F.regexp_replace("path", r"(/__init__)?\.py$", ""), "/", ".")
    by_name = files.groupBy(module.alias("m")).agg(F.min_by("path", F.col("path").endswith("/__init__.py")).alias("file"))
    asked = known.where("kind = 'import'").select(F.col("path").alias("src"), "module", "name", "alias", F.concat_ws(".", "module", "name").alias("inner"))
    one = by_name.select(F.col("m").alias("inner"), F.col("file").alias("sub"))
    two = by_name.select(F.col("m").alias("module"), F.col("file").alias("whole"))
    found = asked.join(one, "inner", "left").join(two, "module", "left")
    defined = known.where("kind in ('class', 'function')").select(F.col("path").alias("whole"), "name", _entity().alias("entity")).distinct()
    found = found.join(defined, ["whole", "name"], "left")
    goal = F.when(F.col("name").isNull(), F.col("whole")).otherwise(F.coalesce("sub", "entity", "whole"))
    return found.select("src", goal.alias("dst"), "alias").where("dst is not null")


def _inits(links: DataFrame) -> DataFrame:
    """(src, file): each file with itself and the packages that it imports, directly or through packages."""
    step = links.where("dst like '%\\_\\_init\\_\\_.py' and src like '%.py'").select(F.col("src").alias("file"), F.col("dst").alias("next")).distinct()
    reached = links.select("src", F.col("src").alias("file")).distinct()
    while True:  # a round for each package on the longest way
        more = reached.join(step, "file").select("src", F.col("next").alias("file"))
        wider = reached.union(more).distinct()
        if wider.count() == reached.count():
            return reached
        reached = wider


def uses(known: DataFrame) -> DataFrame:
    """(src, dst, type): what classes inherit, and what functions and classes' own `__init__` call, by visible names.

    Visible are the definitions of the scopes around, with those in classes there, but not the scopes themselves; what the
    file imports, by its name or alias, with what is in imported files and classes; and the same of packages that it
    imports. All definitions of a name count.
    """
    used = known.where("kind in ('invokes', 'inherits')").select("path", F.col("name").alias("user"), F.col("kind").alias("type"), F.col("module").alias("called"))
    inner = known.where("kind = 'member'").select("path", F.col("name").alias("scope"), F.col("module").alias("inner"), F.substring_index("module", ".", -1).alias("called"))
    parts = F.split("user", r"\.")
    around = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    scopes = used.withColumn("scope", F.explode(around))
    near = scopes.join(inner, ["path", "scope", "called"]).where("user != inner and not startswith(user, concat(inner, '.'))")
    near = near.select(_entity("path", "user").alias("src"), _entity("path", "inner").alias("dst"), "type")
    links = imports(known)
    typed = nodes(known).select(F.col("id").alias("dst"), F.col("type").alias("kind"))
    reached = _inits(links)
    brought = reached.join(links.select(F.col("src").alias("file"), "dst", "alias"), "file").join(typed, "dst")
    by_alias = brought.where("alias is not null").select("src", F.col("alias").alias("called"), "dst")
    itself = brought.where("kind in ('class', 'function')").select("src", F.substring_index(F.substring_index("dst", ":", -1), ".", -1).alias("called"), "dst")
    scope_of = inner.select(F.when(F.col("scope") == "", F.col("path")).otherwise(_entity("path", "scope")).alias("of"), "called", _entity("path", "inner").alias("goal"))
    within = brought.where("kind in ('file', 'class')").select("src", F.col("dst").alias("of")).union(reached.where("src != file").select("src", F.col("file").alias("of")))
    within = within.distinct().join(scope_of, "of").select("src", "called", F.col("goal").alias("dst"))
    far = by_alias.union(itself).union(within).withColumnRenamed("src", "path").distinct()
    far = used.join(far, ["path", "called"]).select(_entity("path", "user").alias("src"), "dst", "type")
    return near.union(far).distinct()
