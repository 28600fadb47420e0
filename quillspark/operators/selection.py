"""Filters, path rules, joins and selections of corpus building.

Null texts and paths count as empty; empty tables give empty tables; rows that repeat are
judged one by one unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import stem, symbol
from quillspark.operators.curate import MIN_CONFIDENCE, TRAINABLE_REVIEWS

#: Folders that hold no production code.
NON_PRODUCTION = r"(?i)^(?:tests?|testing|testdata|specs?|examples?|demos?|benchmarks?|fixtures?|vendor|third[_-]?party|node_modules|docs?|documentation|mocks?|generated)$"
#: Symbols that claim nothing.
GENERIC_SYMBOLS = (
    "main", "init", "true", "false", "none", "null", "this", "self",
    "string", "object", "return", "public", "private", "static", "class",
    "function", "system", "windows", "program", "application", "error",
)
#: Weights of what a source claims about its artifact.
CLAIM_WEIGHTS = {"functions": 0.25, "dependencies": 0.2, "apis": 0.35, "literals": 0.2}
#: Behaviours that decide a review, and the files that run first.
DECISIVE = ("Command Execution", "Credential Collection", "Sensitive File Access", "Persistence", "Dynamic Download")
ENTRY_POINTS = ("setup.py", "__init__.py", "package.json", "index.js", "main.js")
MAX_SOURCE_BYTES, MIN_SOURCE_CHARACTERS = 128 * 1024, 24


def task_eligible(task: str, label: Column, confidence: Column, status: Column, scopes: Column) -> Column:
    """Whether a row may train a task; scopes opt in, rows without any keep the defaults of their label."""
    reviewed = (confidence >= MIN_CONFIDENCE) & status.isin(*TRAINABLE_REVIEWS)
    free, named = F.size(scopes) == 0, F.array_contains(scopes, task)
    if task == "malicious_intent":
        return reviewed & ((label == "benign") | ((label == "malicious") & (free | named)))
    if task == "vulnerability_risk":
        return reviewed & F.when(free, label.isin("benign", "vulnerable")).otherwise(named)
    return F.lit(False)


def source_fate(df: DataFrame, excluded: Column, generated: Column, own: str = "hash", parent: str = "parent_hash") -> DataFrame:
    """Add ``fate``: direct (a hash of the excluded source), generated, derivative (of such a hash) or retained."""
    bad = df.filter(excluded).select(F.col(own).alias("_bad")).distinct()
    found = df.join(bad, F.col(own) == F.col("_bad"), "left").withColumn("_direct", F.col("_bad").isNotNull()).drop("_bad")
    found = found.join(bad, F.col(parent) == F.col("_bad"), "left").withColumn("_derived", F.col("_bad").isNotNull()).drop("_bad")
    fate = F.when(F.col("_direct"), "direct").when(generated, "generated").when(F.col("_derived"), "derivative").otherwise("retained")
    return found.withColumn("fate", fate).drop("_direct", "_derived")


def path_segments(path: Column) -> Column:
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")


def is_production(path: Column, language: Column) -> Column:
    """No folder of tests, examples, vendored or generated code, and no test file of its language."""
    parts = path_segments(path)
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    name = F.lower(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")))
    test = ((language == "go") & name.endswith("_test.go")) | ((language == "php") & name.rlike(r"(^|[_.-])tests?([_.-]|$)"))
    return ~F.exists(folders, lambda x: x.rlike(NON_PRODUCTION)) & ~test


def glob_pattern(glob: Column) -> Column:
    """A glob as a regular expression for whole lower-cased paths; ``*`` crosses folders."""
    escaped = F.regexp_replace(F.lower(F.replace(glob, F.lit("\\"), F.lit("/"))), r"([.+^$(){}|])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("[!"), F.lit("[^")), F.lit("$"))


def any_glob(path: Column, globs: Column) -> Column:
    """Whether a path matches any of an array of globs."""
    return F.exists(globs, lambda g: F.rlike(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), glob_pattern(g)))


def visible(df: DataFrame, user: str) -> DataFrame:
    """A user's own records that belong to no project."""
    return df.filter((F.col("username") == user) & (F.coalesce("project_job_id", F.lit("")) == ""))


def decodable(raw: Column) -> Column:
    """Source that is read at all: bounded, without a NUL byte in its first 4 KiB, and of some length."""
    text = F.trim(F.decode(raw, "UTF-8"))
    return (F.octet_length(raw) <= MAX_SOURCE_BYTES) & (F.locate("00", F.regexp_replace(F.hex(F.substring(raw, 1, 4096)), "(..)", "$1 ")) == 0) & (F.length(text) >= MIN_SOURCE_CHARACTERS)


def allowed_url(url: Column, hosts: tuple[str, ...]) -> Column:
    """HTTPS, a host of the list, no credentials."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    return F.coalesce((part("PROTOCOL") == "https") & F.lower(part("HOST")).isin(*hosts) & part("USERINFO").isNull(), F.lit(False))


def changed_files(infected: DataFrame, clean: DataFrame, package: str, content: str, member: str) -> DataFrame:
    """Files of packages that have a clean version, without those it has too and without package metadata."""
    paired = infected.join(clean.select(package).distinct(), package, "left_semi")
    return paired.join(clean.select(package, content).distinct(), [package, content], "left_anti").filter(~F.contains(F.lower(F.col(member)), F.lit("package_info-")))


def by_stem(files: DataFrame, expected: DataFrame, path: str, name: str) -> DataFrame:
    """Files whose name without suffix is expected, with what is expected of it."""
    return files.join(expected, stem(path) == F.col(name))


def resolve(references: DataFrame, files: DataFrame, by: str = "project", target: str = "target", path: str = "path") -> DataFrame:
    """Add ``file`` to references: the file of that path, else the only one that ends so, else the only one of that stem.

    Endings are made from the files (one for each folder), so that all three are equi-joins. They are dealt
    before they are counted: a count that keeps a path is sorted, and most endings are there once, so that
    sorting all of a split of the input first would take memory and save nothing.
    """
    parts = F.split(path, "/")
    ends = files.select(by, path, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("_end"))
    one = lambda df, key, name: df.repartition(by, key).groupBy(by, key).agg(F.min(path).alias(name), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    exact = files.select(by, F.col(path).alias(target), F.col(path).alias("_exact")).distinct()
    endings = one(ends, "_end", "_by_end").withColumnRenamed("_end", target)
    stems = one(files.select(by, path, stem(path).alias("_stem")), "_stem", "_by_stem")
    found = references.join(exact, [by, target], "left").join(endings, [by, target], "left").withColumn("_stem", stem(target)).join(stems, [by, "_stem"], "left")
    return found.withColumn("file", F.coalesce("_exact", "_by_end", "_by_stem")).select(*references.columns, "file")


def calls(functions: DataFrame, by: str = "file", name: str = "name", body: str = "body") -> DataFrame:
    """(by, source, target): functions of one file that another one's body names."""
    words = functions.select(by, F.col(name).alias("source"), F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("target"))
    return words.join(functions.select(by, F.col(name).alias("target")).distinct(), [by, "target"], "left_semi").filter("source <> target").select(by, "source", "target").distinct()


def routed(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """Add ``version``: the route of (task, language), else that of the task for all languages."""
    own = routes.select("task", "language", F.nullif("version", F.lit("")).alias("_own"))
    every = routes.filter("language = 'all'").select("task", F.nullif("version", F.lit("")).alias("_all"))
    return requests.join(own, ["task", "language"], "left").join(every, "task", "left").withColumn("version", F.coalesce("_own", "_all")).drop("_own", "_all")


def ordered_evidence(items: DataFrame, seq: str, limit: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """The first items of each group: corroborated ones, then those of models alone, then those of rules alone."""
    tier = F.when(F.col("basis") == "ai_and_rule", 0).when(F.col("basis") == "ai_only", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(tier, seq))
    return items.withColumn("place", place).filter(F.col("place") <= limit)


def training_gate(graphs: DataFrame, leaks: Column) -> DataFrame:
    """One row of checks over graphs (split, label): leaks, both labels in each split, enough cases."""
    of = lambda split, label: F.count(F.when((F.col("split") == split) & (F.col("label") == label), 1))
    both = F.lit(True)
    for split in ("train", "validation", "test"):
        both = both & (of(split, "vulnerable") > 0) & (of(split, "fixed") > 0)
    checks = {"no_leakage": leaks, "both_labels": both, "train_60": of("train", "vulnerable") >= 60, "validation_15": of("validation", "vulnerable") >= 15, "test_15": of("test", "vulnerable") >= 15}
    out = graphs.agg(*[c.alias(n) for n, c in checks.items()])
    return out.withColumn("passed", F.expr(" AND ".join(checks)))


def checked_training_gate(graphs: DataFrame, group: str) -> DataFrame:
    """``training_gate`` whose check for leaks looks whether any group of graphs (split, label, group) is in several splits."""
    leaks = graphs.filter(F.col(group).isNotNull()).groupBy(group).agg((F.min("split") != F.max("split")).alias("torn")).agg(F.coalesce(~F.bool_or("torn"), F.lit(True)).alias("_clean"), F.lit(True).alias("_one"))
    known = graphs.withColumn("_one", F.lit(True)).join(F.broadcast(leaks), "_one")  # one row
    return training_gate(known, F.coalesce(F.bool_and("_clean"), F.lit(True)))


def similarity(claims: DataFrame, seen: DataFrame, by: str) -> DataFrame:
    """by, n_matched, similarity: weighted share of claims (by, kind, symbol) seen (by, symbol), over kinds that claim anything.

    Shares are decimals, so that a half rounds up whatever the order they are added in.
    """
    known = seen.select(by, "symbol", F.lit(1).alias("_seen")).distinct()
    per = claims.select(by, "kind", "symbol").distinct().join(known, [by, "symbol"], "left").groupBy(by, "kind").agg(F.count("_seen").alias("m"), F.count("*").alias("c"))
    weight = F.create_map(*[x for k, w in CLAIM_WEIGHTS.items() for x in (F.lit(k), F.lit(round(w * 100)))])[F.col("kind")]
    share = (weight * F.col("m")).cast("decimal(20,0)") / F.col("c").cast("decimal(18,0)")
    total = per.groupBy(by).agg(F.sum("m").alias("n_matched"), F.sum(share).cast("decimal(22,18)").alias("_w"), F.sum(weight).cast("decimal(3,0)").alias("_all"))
    exact = F.round(100 * F.col("_w") / F.col("_all"), 12)
    return total.select(by, "n_matched", F.round(exact, 1).cast("double").alias("similarity"))


def claim_symbols(value: Column) -> Column:
    """The symbols of a name: itself and its parts, normalised, without short and generic ones, sorted."""
    parts = F.concat(F.array(value), F.split(value, r"[./:$@?\\-]+"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, symbol), lambda x: (F.length(x) >= 4) & ~x.isin(*GENERIC_SYMBOLS))))


def review_decision(source: Column, behaviors: Column, path: Column, has_clean: Column) -> Column:
    """The status that evidence gives a sample, or needs_human_review."""
    decisive = F.size(F.array_intersect(behaviors, F.array(*map(F.lit, DECISIVE))))
    compared = (source == "compromised_diff") & has_clean & (decisive > 0) & ((F.size(behaviors) >= 2) | F.array_contains(behaviors, "Install Hook Execution"))
    entry = F.lower(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)).isin(*ENTRY_POINTS)
    chained = (source == "malicious_intent") & entry & (decisive >= 2) & (F.size(behaviors) >= 3)
    return F.when(compared, "differentially_verified").when(chained, "behavior_verified").otherwise("needs_human_review")


def measurement_status(chains: Column, with_graphs: Column, ranked: Column, completed: Column) -> Column:
    return F.when(chains == 0, "insufficient_ground_truth").when(~with_graphs, "measured_without_graphs").when((ranked > 0) & (completed == ranked), "measured").otherwise("partial_measurement")


def pair_key(pair_id: Column, path: Column) -> Column:
    """The given key of a pair, else its path with the side's name replaced."""
    return F.coalesce(F.nullif(pair_id, F.lit("")), F.regexp_replace(F.coalesce(path, F.lit("")), r"/(?:bad|good)_", "/PAIR_"))


def registry_name(segment: Column) -> Column:
    """A scoped package's name from its folder: ``@scope@name`` is ``@scope/name``."""
    return F.regexp_replace(segment, r"^@([^@]*)@", r"@$1/")


def repository_and_commit(name: Column) -> tuple[Column, Column]:
    """What a patch's name says: repository, and commit (unknown without one)."""
    commit = F.regexp_extract(name, r"_([0-9a-f]{40})$", 1)
    return F.when(commit == "", name).otherwise(F.regexp_replace(name, r"_[0-9a-f]{40}$", "")), F.when(commit == "", "unknown").otherwise(commit)


def without_header_comment(code: Column) -> Column:
    """Without the comment of markup that a text begins with."""
    return F.regexp_replace(code, r"(?s)\A\s*<!--.*?-->\s*", "")


def normal_path(path: Column) -> Column:
    """A relative path without ``.``, ``..`` and doubled separators; nothing for what is no file."""
    whole = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    rooted = whole.startswith("/")

    def step(done: Column, part: Column) -> Column:
        up = F.size(done) > 0
        last = F.try_element_at(done, F.lit(-1))
        back = F.when(up & (last != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(rooted, done).otherwise(F.concat(done, F.array(F.lit(".."))))
        return F.when(part.isin("", "."), done).when(part == "..", back).otherwise(F.concat(done, F.array(part)))

    joined = F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(joined == "..", "").otherwise(joined)


def canonical_path(path: Column) -> Column:
    """A file's path inside its package, in lower case."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    low = F.transform(parts, lambda x: F.lower(x))
    at = F.array_position(low, "package").cast("int")
    rest = F.filter(low, lambda x, k: F.exists(F.slice(low, 1, k + 1), lambda y: ~(y.startswith("tmp") | y.endswith(".tar.gz") | y.endswith(".zip"))))
    named = (F.size(rest) > 1) & F.coalesce(F.get(rest, 0), F.lit("")).rlike(r"[-_][0-9]")
    cut = F.when(at > 0, F.slice(low, at + 1, F.size(low))).when(named, F.slice(rest, 2, F.size(rest))).otherwise(rest)
    return F.array_join(cut, "/")


def web_shell_family(path: Column, label: Column) -> Column:
    """The family that a script's name stands for: its collection and its first three words without versions."""
    parts = F.split(path, "/")
    collection = F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2)).otherwise("root")
    name = F.regexp_replace(F.lower(stem(path)), r"^sourcecode_[a-z0-9]+_", "")
    words = F.filter(F.split(F.regexp_replace(name, r"(?:v(?:ersion)?[-_. ]*)?[0-9]+(?:[._-][0-9]+)*", ""), r"[^a-z]+"), lambda x: F.length(x) >= 2)
    identity = F.array_join(F.slice(words, 1, 3), "-")
    return F.concat(F.lit("php-corpus:"), label, F.lit(":"), collection, F.lit(":"), F.when(identity != "", identity).otherwise(F.substring(F.sha2(path, 256), 1, 16)))


def most_severe(findings: DataFrame, by: str, fallback: str) -> DataFrame:
    """by, category (of the greatest severity, the first on ties), behaviors and cwes (sorted, distinct)."""
    got = findings.groupBy(by).agg(F.max(F.struct("severity", (-F.col("seq")).alias("s"), "category"))["category"].alias("category"), F.array_sort(F.collect_set(F.nullif("category", F.lit("")))).alias("behaviors"), F.array_sort(F.collect_set(F.nullif("cwe", F.lit("")))).alias("cwes"))
    return got.withColumn("category", F.coalesce("category", F.lit(fallback))).withColumn("behaviors", F.when(F.size("behaviors") == 0, F.array(F.lit(fallback))).otherwise(F.col("behaviors")))


def top_counts(df: DataFrame, value: str, limit: int) -> DataFrame:
    """The ``limit`` most frequent values (ties: the smallest), by partial aggregates and a bounded sort."""
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(limit)
