"""What a caller asks of an indexed corpus: contexts, documents, the graph around a name, figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import assembly, graph, tables


def search_context(vectors: DataFrame, documents: DataFrame, edges: DataFrame, node_vectors: DataFrame, node_docs: DataFrame, query: list[float], **options: object) -> dict:
    """The context of a query as Markdown and the documents that it is from."""
    row = assembly.rendered(assembly.assemble(vectors, documents, edges, node_vectors, node_docs, query, **options)).first()
    return {"context": row["context"] or "", "sources": list(row["sources"])}


def list_documents(documents: DataFrame, source_type: str = "", status: str = "") -> DataFrame:
    """Documents, newest first; an empty filter asks for nothing."""
    return tables.filtered(documents, source_type=source_type, status=status).orderBy(F.desc("updated_at"), "id")


def get_document(documents: DataFrame, document_id: object) -> dict | None:
    row = tables.lookup(documents, id=document_id).first()
    return None if row is None else row.asDict(recursive=True)


def get_graph_context(nodes: DataFrame, edges: DataFrame, name: str, depth: int = 1) -> str:
    """The graph around what a name means, as text; empty if it means nothing."""
    start = graph.seeds(nodes, name)
    near = graph.hops(edges, start, depth)
    found = nodes.join(near, "id").withColumns({"is_seed": F.col("hop") == 0, "pos": F.struct("hop", "id")})
    return "" if found.isEmpty() else graph.context_text(found, graph.induced(edges, near)).first()["text"]


def stats(documents: DataFrame, **others: DataFrame) -> DataFrame:
    """One row: how many documents there are, of code by kind, and rows of the other tables."""
    kinds = ("code_file_summary", "code_doc", "code_summary", "git_code")
    out = documents.agg(F.count("*").alias("document_count"), *(F.count_if(F.col("source_type") == k).alias(f"{k}_count") for k in kinds))
    for name, df in others.items():
        out = out.join(df.agg(F.count("*").alias(f"{name}_count")))
    return out
