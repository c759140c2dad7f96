"""Typed schemas of the seven node tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

VECTOR = ArrayType(DoubleType(), containsNull=False)


def _schema(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


_S, _B, _I, _T = StringType(), BooleanType(), IntegerType(), TimestampType()

USER = _schema(
    userId=_S, username=_S, firstName=_S, lastName=_S, email=_S, role=_S, isActive=_B
)
STATUS = _schema(statusId=_S, name=_S, isClosed=_B)
PRIORITY = _schema(priorityId=_S, name=_S, level=_I)
CATEGORY = _schema(categoryId=_S, name=_S, description=_S)
TICKET = _schema(
    ticketId=_S,
    title=_S,
    description=_S,
    creationDate=_T,
    resolvedDate=_T,
    resolutionSummary=_S,
    createdByUserId=_S,
    assignedToUserId=_S,
    statusId=_S,
    priorityId=_S,
    categoryId=_S,
)
COMMENT = _schema(
    commentId=_S,
    content=_S,
    creationDate=_T,
    isSolution=_B,
    ticketId=_S,
    authorUserId=_S,
    articleId=_S,
)
ARTICLE = _schema(articleId=_S, title=_S, summary=_S, referenceUrl=_S, categoryId=_S)

SCHEMAS = {
    "user": USER,
    "status": STATUS,
    "priority": PRIORITY,
    "category": CATEGORY,
    "ticket": TICKET,
    "comment": COMMENT,
    "article": ARTICLE,
}

KEYS = {label: schema.fieldNames()[0] for label, schema in SCHEMAS.items()}

# Columns that only serve to build edges.
FOREIGN_KEYS = {
    "ticket": ["createdByUserId", "assignedToUserId", "statusId", "priorityId", "categoryId"],
    "comment": ["ticketId", "authorUserId", "articleId"],
    "article": ["categoryId"],
}


@dataclass(frozen=True)
class SupportGraph:
    """The node tables with their foreign keys still in place; the joins follow those.

    Retrieval needs the first four only.
    """

    user: DataFrame
    status: DataFrame
    ticket: DataFrame
    comment: DataFrame
    priority: DataFrame | None = None
    category: DataFrame | None = None
    article: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        """The tables that are present, by label."""
        found = {f.name: getattr(self, f.name) for f in fields(self)}
        return {label: df for label, df in found.items() if df is not None}
