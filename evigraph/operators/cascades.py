"""What is left of a workspace when documents, a project's graph or whole projects go.

A workspace is a dict of tables; lists of references are link tables (owner, target), so that a node, candidate or registry entry
with very many of them is spread over tasks. Tables that a caller doesn't have are left out. Tables and their keys:

projects, jobs, manifests, resolutions (project_id); documents, analyses (project_id, document_id); blocks (document_id, block_id);
evidence (document_id, evidence_id); threads (project_id, thread_id); messages (thread_id); nodes (project_id, node_id);
edges (project_id, edge_id, source_id, target_id); candidates (project_id, candidate_id); claims (project_id, claim_id, block_id);
coverage (project_id, block_id); registry (project_id, registry_id, status); proposals (project_id, proposal_id, status); and the links.

A link table may carry the ``project_id`` of its owners, which are not asked for theirs then. Keys of owners and of projects are counted and broadcast as long as they are few.
Tables that several others are made of are written once.

Further columns pass through. Null references are links to nothing and stay. Repeated rows stay or go together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import few, staged

Tables = dict[str, DataFrame]

#: link table: (table of its owner, the owner's key, key of the target)
LINKS = {
    "node_evidence": ("nodes", "node_id", "evidence_id"),
    "edge_evidence": ("edges", "edge_id", "evidence_id"),
    "candidate_blocks": ("candidates", "candidate_id", "block_id"),
    "candidate_documents": ("candidates", "candidate_id", "document_id"),
    "registry_blocks": ("registry", "registry_id", "block_id"),
    "registry_members": ("registry", "registry_id", "candidate_id"),
    "registry_claims": ("registry", "registry_id", "claim_id"),
    "proposal_documents": ("proposals", "proposal_id", "document_id"),
}

#: tables without a project of their own: (table that owns them, key)
OWNED = {"blocks": ("documents", "document_id"), "evidence": ("documents", "document_id"), "messages": ("threads", "thread_id")}

#: owners that go without a link of this kind
NEEDS = {"nodes": "node_evidence", "edges": "edge_evidence", "candidates": "candidate_blocks"}

#: owners that keep their row, but get this status without a link of this kind; of proposals only those pending are touched
ORPHANS = {"registry": ("registry_blocks", "orphaned"), "proposals": ("proposal_documents", "superseded")}


def _all(table: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in table.columns]


def _flagged(rows: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """``rows`` + ``flag``: whether their ``key`` is among ``keys``."""
    return rows.join(keys.select(key).distinct().withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def _keys(rows: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    return few(staged(rows.select(key).distinct(), "cascade-keys"), most)


def _touched(name: str) -> Column:
    """Owners in the projects at hand whose links may be cut."""
    return F.col("__mine") & (F.col("status") == "pending") if name == "proposals" else F.col("__mine")


def _without(rows: DataFrame, flag: Column, like: DataFrame) -> DataFrame:
    return rows.filter(~flag).select(*_all(like))


def remove_documents(tables: Tables, gone: DataFrame) -> Tables:
    """The workspace without the documents in ``gone`` (project_id, document_id).

    Documents, analyses, blocks and evidence go. Only records of the documents' own projects are changed: their links to what went are cut; nodes,
    edges and candidates without a link left go, edges also without one of their ends; claims and coverage of dead blocks go; registry
    entries lose dead blocks, candidates and claims, and are orphaned without a block; pending proposals without a document are superseded. Another project's
    record keeps its links, though their targets are gone. With ``gone`` empty nothing changes.
    """
    gone = staged(gone.select("project_id", "document_id").distinct(), "cascade-gone")
    out, documents, projects = dict(tables), _keys(gone, "document_id", 1_000_000), _keys(gone, "project_id")
    dead, went = {"document_id": documents}, {}
    for name, key in (("blocks", "block_id"), ("evidence", "evidence_id")):
        if name in tables:
            dead[key] = _keys(tables[name].join(documents, "document_id", "left_semi"), key)  # read by every link
    for name in ("documents", "analyses", "blocks", "evidence"):
        if name in tables:
            out[name] = tables[name].join(documents, "document_id", "left_anti").select(*_all(tables[name]))
    for name in ("claims", "coverage"):
        if name in tables and "block_id" in dead:
            rows = _flagged(_flagged(tables[name], projects, "project_id", "__mine"), dead["block_id"], "block_id", "__dead")
            out[name] = _without(rows, F.col("__mine") & F.col("__dead"), tables[name])
    if "claims" in out and "registry_claims" in tables:
        out["claims"] = staged(out["claims"], "cascade-claims")

    def cut(link: str) -> None:
        owner, key, target = LINKS[link]
        if link not in tables or owner not in tables:
            return
        if "project_id" in tables[link].columns and owner != "proposals":
            rows = _flagged(tables[link], projects, "project_id", "__owned")
        else:
            mine = _flagged(tables[owner], projects, "project_id", "__mine").filter(_touched(owner))
            rows = _flagged(tables[link], _keys(mine, key), key, "__owned")
        alive = {"candidate_id": "candidates", "claim_id": "claims"}.get(target)
        if alive in out:  # these must be among the living ones of the project
            living = out[alive].join(projects, "project_id", "left_semi")
            if alive == "candidates":
                living = _keys(living, target)
            lost = ~F.col("__alive") & F.col(target).isNotNull()
            out[link] = _without(_flagged(rows, living, target, "__alive"), F.col("__owned") & lost, tables[link])
        elif target in dead:
            out[link] = _without(_flagged(rows, dead[target], target, "__dead"), F.col("__owned") & F.col("__dead"), tables[link])
        if link in (*NEEDS.values(), *[by for by, _ in ORPHANS.values()]):
            out[link] = staged(out[link], f"cascade-{link}")  # what the owner still holds, and what is left

    def settle(owner: str) -> None:
        link = NEEDS[owner] if owner in NEEDS else ORPHANS[owner][0]
        if owner not in tables or link not in out:
            return
        held = out[link].filter(F.col(LINKS[link][2]).isNotNull())
        rows = _flagged(_flagged(tables[owner], projects, "project_id", "__mine"), held, LINKS[link][1], "__held")
        empty = _touched(owner) & ~F.col("__held")
        if owner == "edges" and "nodes" in out:
            nodes = _keys(out["nodes"], "node_id")
            for end in ("source_id", "target_id"):
                rows = _flagged(rows, nodes.withColumnRenamed("node_id", end), end, f"__{end}")
            empty = F.col("__mine") & ~(F.col("__held") & F.col("__source_id") & F.col("__target_id"))
        if owner in NEEDS:
            key = LINKS[link][1]
            settled = staged(rows.select(*_all(tables[owner]), F.coalesce(empty, F.lit(False)).alias("__gone")), f"cascade-{owner}")  # edges, links and the registry ask for these
            out[owner] = _without(settled, F.col("__gone"), tables[owner])
            went[owner] = _keys(settled.groupBy(key).agg(F.bool_and("__gone").alias("__gone")).filter("__gone"), key)
            out[link] = _of_others(out[link], went[owner], key)
        else:
            status = F.when(empty, ORPHANS[owner][1]).otherwise(F.col("status"))
            out[owner] = rows.withColumn("status", status).select(*_all(tables[owner]))

    for link in ("node_evidence", "edge_evidence", "candidate_blocks", "candidate_documents", "proposal_documents", "registry_blocks"):
        cut(link)
    for owner in ("nodes", "edges", "candidates", "registry", "proposals"):
        settle(owner)
    if "candidates" in went and "candidate_documents" in out:
        out["candidate_documents"] = _of_others(out["candidate_documents"], went["candidates"], "candidate_id")
    for link in ("registry_members", "registry_claims"):
        cut(link)
    return out


def _of_others(links: DataFrame, went: DataFrame, key: str) -> DataFrame:
    """``links`` without those of the owners that went."""
    return links.join(went, key, "left_anti").select(*_all(links))


def _under(links: DataFrame, before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``links`` without those of owners that went."""
    return _of_others(links, _keys(before.select(key).join(after.select(key), key, "left_anti"), key), key)


def clear_project_graph(tables: Tables, gone: DataFrame) -> Tables:
    """The workspace without the graphs of the projects in ``gone`` (project_id).

    Their nodes, edges, candidates (with their links), claims and coverage go; documents, blocks and the registry stay. So does evidence that no cleared graph cites, or that another project's does.
    """
    out, gone = dict(tables), _keys(gone, "project_id")
    for name in ("nodes", "edges", "candidates", "claims", "coverage"):
        if name in tables:
            out[name] = tables[name].join(gone, "project_id", "left_anti").select(*_all(tables[name]))
    cited = []
    for link in ("node_evidence", "edge_evidence", "candidate_blocks", "candidate_documents"):
        owner, key, target = LINKS[link]
        if link not in tables or owner not in tables:
            cited += [tables[link].select(target, F.lit(False).alias("__cleared"))] if link in tables and target == "evidence_id" else []
            continue
        if "project_id" in tables[link].columns:
            went, key = gone, "project_id"
        else:
            went = _keys(tables[owner].select(key).join(out[owner].select(key), key, "left_anti"), key)
        out[link] = _of_others(tables[link], went, key)
        if target == "evidence_id":
            cited.append(_flagged(tables[link], went, key, "__cleared").select(target, "__cleared"))
    if {"evidence", "node_evidence", "edge_evidence"} <= set(tables):
        dead = cited[0].union(cited[1]).groupBy("evidence_id").agg(F.bool_and("__cleared").alias("__cleared")).filter("__cleared")
        out["evidence"] = tables["evidence"].join(dead.select("evidence_id").hint("merge"), "evidence_id", "left_anti").select(*_all(tables["evidence"]))
    return out


def delete_projects(tables: Tables, gone: DataFrame) -> Tables:
    """The workspace without the projects in ``gone`` (project_id): all tables lose their rows, links go with their owners, blocks and evidence with documents, messages with threads."""
    out, gone = dict(tables), _keys(gone, "project_id")
    owned = OWNED | {link: (owner, key) for link, (owner, key, _) in LINKS.items()}
    for name in [*sorted(set(tables) - set(owned)), *sorted(set(tables) & set(owned))]:
        if name not in owned:
            out[name] = tables[name].join(gone, "project_id", "left_anti").select(*_all(tables[name]))
            continue
        owner, key = owned[name]
        if "project_id" in tables[name].columns and name in LINKS:
            out[name] = _of_others(tables[name], gone, "project_id")
        else:
            out[name] = _under(tables[name], tables[owner], out[owner], key)
    return out
