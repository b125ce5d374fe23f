"""References: resolution, listing, overlay, updates, pruning, digests, checks before writing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bough.functions import octets as O
from bough.model import EngineError
from bough.plans.stages import spill

HOPS = 16


def resolve(refs: DataFrame, wanted: DataFrame | None = None, hops: int = HOPS) -> DataFrame:
    """(name, target, oid, hops, status) of references (name, kind, oid, symbolic_target), symbolic ones followed.

    status is resolved, not_found, cycle or too_deep (more than 16 hops); oid is null
    unless resolved. Each hop is one join with the table, as long as any reference is
    still symbolic.
    """
    table = refs.select(F.col("name").alias("n"), "kind", "oid", "symbolic_target")
    start = (refs if wanted is None else wanted).select("name").distinct()
    now = start.select("name", F.col("name").alias("target"), F.array("name").alias("chain"))
    # one lookup of where each chain stands; symbolic ones go on
    out = None
    for hop in range(hops + 1):
        at = now.join(table, F.col("target") == F.col("n"), "left")
        next_ = F.col("symbolic_target")
        status = F.when(F.col("n").isNull(), "not_found").when(F.col("kind") == "direct", "resolved").when(F.array_contains("chain", next_), "cycle").when(F.lit(hop == hops), "too_deep")
        at = at.select("name", "target", "chain", "oid", next_.alias("next"), status.alias("status"))
        ended = at.where("status is not null").select("name", "target", F.when(F.col("status") == "resolved", F.col("oid")).alias("oid"), F.lit(hop).alias("hops"), "status")
        out = ended if out is None else out.unionByName(ended)
        going = at.where("status is null")
        if hop == hops or going.isEmpty():
            return out
        now = going.select("name", F.col("next").alias("target"), F.array_append("chain", F.col("next")).alias("chain"))
    return out


def listing(refs: DataFrame, prefix: str | None = None, after: str | bytes | None = None) -> DataFrame:
    """References in order of their names' bytes, from a prefix and behind a name; malformed names aren't listed. Symbolic ones aren't followed."""
    name = F.col("name")
    binary = refs.schema["name"].dataType.simpleString() == "binary"
    text = O.chars(name) if binary else name
    out = refs.where(O.is_ref_name(text))
    if prefix:
        out = out.where(text.startswith(prefix.encode().decode("latin-1") if binary else prefix))
    if after is not None:
        after = after.encode() if isinstance(after, str) and binary else after
        out = out.where(name > F.lit(after))
    return out.orderBy("name")


def malformed(refs: DataFrame) -> DataFrame:
    text = O.chars(F.col("name")) if refs.schema["name"].dataType.simpleString() == "binary" else F.col("name")
    return refs.where(~O.is_ref_name(text)).select("name")


def overlay(loose: DataFrame, packed: DataFrame) -> DataFrame:
    """Both stores together; a loose reference hides the packed one of its name."""
    both = loose.withColumn("__rank", F.lit(0)).unionByName(packed.withColumn("__rank", F.lit(1)))
    rest = [c for c in loose.columns if c != "name"]
    best = both.groupBy("name").agg(F.min_by(F.struct(*rest), "__rank").alias("best"))
    return best.select("name", *(F.col("best")[c].alias(c) for c in rest))


def peel(objects: DataFrame, start: DataFrame, tags: DataFrame, to: str = "commit", hops: int | None = HOPS) -> DataFrame:
    """(start, oid, kind, status) after following tags from ``start`` (oid): resolved, not_found, kind_mismatch (a tag claims another kind than its target has), too_deep or wrong_kind.

    objects is (oid, kind), tags (oid, target_oid, target_kind). Peeling to a tree or
    blob ends at the first object that is no tag. Without ``hops`` tags are followed to
    the end, and only those that lead into a circle are too_deep. What isn't at its end
    is written out hop by hop, so no hop is done again for the next.
    """
    kinds = objects.select(F.col("oid").alias("o"), F.col("kind").alias("k"))
    links = tags.select(F.col("oid").alias("t"), "target_oid", "target_kind")
    now = start.select(F.col("oid").alias("start"), "oid", F.lit(None).cast("string").alias("claimed"), F.lit(None).cast(start.schema["oid"].dataType).alias("mark")).distinct()
    out = None
    hop = 0
    while True:
        at = now.join(kinds, F.col("oid") == F.col("o"), "left").join(links, F.col("oid") == F.col("t"), "left")
        status = F.when(F.col("o").isNull(), "not_found").when(F.col("claimed").isNotNull() & (F.col("claimed") != F.col("k")), "kind_mismatch").when(F.col("k") != "tag", F.when(F.col("k") == to, "resolved").otherwise("wrong_kind")).when(F.col("oid") == F.col("mark") if hops is None else F.lit(hop == hops), "too_deep")
        at = spill(at.withColumn("status", status))
        ended = at.where("status is not null").select("start", "oid", F.col("k").alias("kind"), "status")
        out = ended if out is None else out.unionByName(ended)
        going = at.where("status is null")
        if hop == hops or going.isEmpty():
            return out
        mark = "mark" if hop & (hop - 1) else "oid"  # of a circle one is met again that is passed at a power of two
        now = going.select("start", F.col("target_oid").alias("oid"), F.col("target_kind").alias("claimed"), F.col(mark).alias("mark"))
        hop += 1


def selector(kind: str, value: str | None = None) -> tuple[str, str | bytes]:
    """("ref", full name) or ("oid", hex) of a snapshot selector: oid, ref, branch, tag or head. Revision expressions are refused."""
    if kind == "head":
        return "ref", "HEAD"
    if kind == "revspec":
        raise EngineError("unsupported_operation", "revision expressions aren't supported")
    if not isinstance(value, str):
        raise TypeError("a selector's value is text")
    if kind == "oid":
        if not re.fullmatch("[0-9a-fA-F]{40}|[0-9a-fA-F]{64}", value):
            raise EngineError("invalid_oid", "an id is given in full, in hexadecimal")
        return "oid", value.lower()
    prefix = {"ref": "", "branch": "refs/heads/", "tag": "refs/tags/"}.get(kind)
    if prefix is None:
        raise EngineError("invalid_argument", f"unknown selector {kind!r}")
    return "ref", prefix + value


def classify(current: DataFrame, offered: DataFrame, ancestors: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """(name, action, reason, old_oid, new_oid): what an update of references does.

    current: (name, oid, checked_out boolean). offered: (name, oid, force boolean),
    where a null oid is an unborn reference. ancestors: pairs (ancestor, descendant),
    reflexive or not. objects: (oid) that arrived. Actions are created, fast_forward,
    forced and rejected; what doesn't change isn't listed.
    """
    c = current.select("name", F.col("oid").alias("old_oid"), "checked_out")
    o = offered.select("name", F.col("oid").alias("new_oid"), "force")
    both = o.join(c, "name", "left")
    forward = ancestors.select(F.col("ancestor").alias("x"), F.col("descendant").alias("y"), F.lit(True).alias("forward")).distinct()
    both = both.join(forward, (F.col("old_oid") == F.col("x")) & (F.col("new_oid") == F.col("y")), "left")
    there = F.lit(True)
    if objects is not None:
        both = both.join(objects.select(F.col("oid").alias("z"), F.lit(True).alias("there")).distinct(), F.col("new_oid") == F.col("z"), "left")
        there = F.coalesce("there", F.lit(False))
    tag = F.col("name").startswith("refs/tags/")
    forced, ahead = F.coalesce("force", F.lit(False)), F.coalesce("forward", F.lit(False))
    reason = (
        F.when(F.col("new_oid").isNull() & F.col("old_oid").isNotNull(), "replace_with_unborn")
        .when(~there, "source_object_not_found")
        .when(F.col("old_oid").isNotNull() & F.coalesce("checked_out", F.lit(False)), "currently_checked_out")
        .when(F.col("old_oid").isNotNull() & tag & ~forced, "tag_update")
        .when(F.col("old_oid").isNotNull() & ~ahead & ~forced, "non_fast_forward")
    )
    action = F.when(reason.isNotNull(), "rejected").when(F.col("old_oid").isNull(), "created").when(ahead & ~tag, "fast_forward").otherwise("forced")
    return both.where("not (old_oid <=> new_oid)").select("name", action.alias("action"), reason.alias("reason"), "old_oid", "new_oid")


def map_refspec(spec: str) -> tuple[str, str, bool]:
    """(source, destination, force) of a fetch refspec; both sides have one wildcard or none."""
    force, spec = spec.startswith("+"), spec.removeprefix("+")
    source, colon, target = spec.partition(":")
    if not colon or not target or not source:
        raise EngineError("invalid_argument", "a refspec has a source and a destination")
    if source.count("*") != target.count("*") or source.count("*") > 1:
        raise EngineError("invalid_argument", "both sides of a refspec have one wildcard or none")
    return source, target, force


def mapped(remote: DataFrame, specs: list[str]) -> DataFrame:
    """(name, source, oid, force): remote references (name, oid) under their local names; an exact source that isn't there is a ref_not_found."""
    out = None
    for spec in specs:
        source, target, force = map_refspec(spec)
        if "*" in source:
            (a, b), (c, d) = source.split("*"), target.split("*")
            here = remote.where(F.col("name").startswith(a) & F.col("name").endswith(b) & (F.length("name") >= len(a + b)))
            name = F.concat(F.lit(c), F.substr("name", F.lit(len(a) + 1), F.length("name") - len(a + b)), F.lit(d))
        else:
            here, name = remote.where(F.col("name") == source), F.lit(target)
            if here.isEmpty():
                raise EngineError("ref_not_found", f"the remote has no {source}")
        one = here.select(name.alias("name"), F.col("name").alias("source"), "oid", F.lit(force).alias("force"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise EngineError("invalid_argument", "there must be a refspec")
    return out


def prune(local: DataFrame, remote: DataFrame, specs: list[str]) -> DataFrame:
    """(name) of direct local references under wildcard destinations whose source the remote no longer has; exact destinations stay."""
    exact = [t for s, t, _ in map(map_refspec, specs) if "*" not in s]
    out = None
    for spec in specs:
        source, target, _ = map_refspec(spec)
        if "*" not in source:
            continue
        (a, b), (c, d) = source.split("*"), target.split("*")
        here = local.where((F.col("kind") == "direct") & F.col("name").startswith(c) & F.col("name").endswith(d) & (F.length("name") >= len(c + d)))
        back = F.concat(F.lit(a), F.substr("name", F.lit(len(c) + 1), F.length("name") - len(c + d)), F.lit(b))
        kept = here.join(remote.select(F.col("name").alias("r")), back == F.col("r"), "left_semi").select("name", F.lit(True).alias("kept"))
        one = here.select("name").join(kept, "name", "left").select("name", F.coalesce("kept", F.lit(False)).alias("kept"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return local.select("name").limit(0)
    gone = out.groupBy("name").agg(F.max("kept").alias("kept")).where("not kept").select("name")
    return gone.where(~F.col("name").isin(exact)) if exact else gone


def tips_digest(refs: DataFrame, head: str | None = None) -> DataFrame:
    """One row (digest): SHA-256 over the sorted lines "name id" of (name, oid as hex), with "HEAD -> name" if there is a symbolic head.

    The lines of all references come together in one task: a digest of an ordered whole.
    """
    line = F.concat("name", F.lit(" "), F.lower("oid"), F.lit("\n"))
    rows = refs.select(F.encode(line, "UTF-8").alias("line"))
    if head is not None:
        rows = rows.unionByName(refs.sparkSession.createDataFrame([(bytearray(f"HEAD -> {head}\n".encode()),)], "line binary"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda x: x.cast("string")), "")
    return rows.agg(F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"))


def check_write(refs: DataFrame, existing: DataFrame | None = None) -> None:
    """Raise unless all references (name, kind, oid, symbolic_target) can be written at once: valid, distinct, new, none a directory of another, an unborn HEAD naming an absent branch."""
    if not malformed(refs).isEmpty():
        raise EngineError("malformed_ref", "a name is malformed")
    if not refs.groupBy("name").count().where("count > 1").isEmpty():
        raise EngineError("malformed_ref", "a name occurs twice")
    names = refs.select("name")
    if existing is not None:
        if not existing.join(names, "name", "left_semi").isEmpty():
            raise EngineError("conflict", "a reference exists")
        names = names.unionByName(existing.select("name"))
    above = names.select(F.col("name").alias("whole"), F.split("name", "/").alias("p")).select("whole", F.explode(F.expr("transform(sequence(1, greatest(size(p) - 1, 1)), n -> array_join(slice(p, 1, n), '/'))")).alias("name")).where("name <> whole")
    if not names.join(above, "name", "left_semi").isEmpty():
        raise EngineError("malformed_ref", "a reference is a directory of another")
