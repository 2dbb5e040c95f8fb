"""Row shapes shared by the operators."""

from __future__ import annotations

# One detected span of a page.  ``ord`` is the candidate's place in its page: overlap
# resolution depends on it.  Offsets are code points, 0-based, half-open.
CANDIDATE = ("struct<ord:int,type:string,start_offset:int,end_offset:int,"
             "text:string,source:string,confidence:double>")
CANDIDATES = f"array<{CANDIDATE}>"
CANDIDATE_FIELDS = ["ord", "type", "start_offset", "end_offset", "text", "source", "confidence"]

RULES = "rule_idx int, type string, pattern string, enabled boolean"

BOX = "struct<left:double,top:double,width:double,height:double>"


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


# Types are kept as text: a schema can be named before there is a session to parse it.
OCR_FIELDS = {
    "documentId": "string",
    "pages": "array<struct<pageNumber:int, blocks:array<struct<type:string, text:string, "
             f"boundingBox:{BOX}, words:array<struct<text:string, boundingBox:{BOX}>>>>>>",
    "totalPages": "int", "extractedAt": "string", "error": "string", "errorCode": "string",
}
OCR = _ddl(OCR_FIELDS)
ENTITIES_FIELDS = {
    "documentId": "string", "totalEntities": "int",
    "entities": "array<struct<text:string, type:string, page:int, startOffset:int, endOffset:int, source:string, confidence:double>>",
    "sourceContributions": "map<string,int>", "processedAt": "string",
}
ENTITIES_DOCUMENT = _ddl(ENTITIES_FIELDS)
FILE_EVENT = ("struct<Records:array<struct<s3:struct<bucket:struct<name:string>,"
              "object:struct<key:string,size:bigint>>>>>")
CONFIG_FIELDS = {
    "user_id": "string", "method": "string", "residual_scan": "boolean", "alerts": "boolean", "model_id": "string",
    "temperature": "double", "prompt": "string", "rules": "array<struct<type:string,pattern:string,enabled:boolean>>",
    "ignored": "array<string>",
}
CONFIG = _ddl(CONFIG_FIELDS)
