"""The nested schema of documents, as DDL."""

SOURCE = "struct<url:string,fragment:string,path:string>"
BLOCK = (
    "struct<ordinal:int,id:string,type:string,text:string,ordered:boolean,items:array<string>,"
    "definitions:array<struct<term:string,definition:string>>,headers:array<string>,rows:array<array<string>>,"
    "title:string,steps:array<struct<step_id:string,text:string>>,productions:array<struct<lhs:string,rhs:string>>,"
    f"normativity:string,links:array<struct<text:string,href:string,resolved_id:string>>,source:{SOURCE}>"
)
SECTION = f"struct<ordinal:int,id:string,heading:string,level:int,source:{SOURCE},blocks:array<{BLOCK}>>"
#: What an extractor makes of one text.
EXTRACTED = f"struct<title:string,sections:array<{SECTION}>,warnings:array<string>>"
SCHEMA_VERSION = "0.2"

#: Columns of a table of documents, in order.
DOCUMENT = (
    "schema_version", "url", "title", "family", "authority", "document_type", "snapshot_id", "fragment", "extracted_at", "sections", "warnings",
)

BLOCK_FIELDS = ("ordinal", "id", "type", "text", "ordered", "items", "definitions", "headers", "rows", "title", "steps", "productions", "normativity", "links", "source")


def block(**parts) -> dict:
    """A block with every field of the schema."""
    return {name: parts.get(name) for name in BLOCK_FIELDS}
