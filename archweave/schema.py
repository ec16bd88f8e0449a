"""Table schemas of a graph bundle, and the fixed names the model allows."""

from __future__ import annotations

#: Fixed values of the data model.
COMPONENT_TYPES = ("UI", "API", "UseCase", "DomainOp", "Event", "EventHandler", "Custom")
ENTRY_POINT_TYPES = ("UI", "API", "EventHandler", "Custom")
LINK_TYPES = ("sync", "async")
SYSTEM_TYPES = ("domain", "bff", "ui", "other")
API_TYPES = ("REST", "GraphQL", "other")
HTTP_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
PROPERTY_TYPES = ("string", "number", "boolean", "array", "object")

LOCATION = "struct<repository:string,file_path:string,line_number:int,end_line_number:int,method_name:string,url:string>"
SIGNATURE = "struct<parameters:array<struct<name:string,type:string,description:string>>,return_type:string>"
BEHAVIOR = "struct<reads:array<string>,validates:array<string>,modifies:array<string>,emits:array<string>>"
CHANGES = "array<struct<from:string,to:string,trigger:string>>"

#: (column, type, JSON key); ``ord`` is the place in the document, ``raw`` the component's own JSON text.
COMPONENT_FIELDS = (
    ("id", "string", "id"), ("type", "string", "type"), ("name", "string", "name"), ("domain", "string", "domain"), ("module", "string", "module"), ("description", "string", "description"),
    ("source_location", LOCATION, "sourceLocation"), ("route", "string", "route"), ("api_type", "string", "apiType"), ("http_method", "string", "httpMethod"), ("path", "string", "path"),
    ("operation_name", "string", "operationName"), ("entity", "string", "entity"), ("signature", SIGNATURE, "signature"), ("behavior", BEHAVIOR, "behavior"), ("state_changes", CHANGES, "stateChanges"),
    ("business_rules", "array<string>", "businessRules"), ("event_name", "string", "eventName"), ("event_schema", "string", "eventSchema"), ("subscribed_events", "array<string>", "subscribedEvents"), ("custom_type_name", "string", "customTypeName"),
)

COMPONENTS = "graph_id string, ord bigint, " + ", ".join(f"{c} {t}" for c, t, _ in COMPONENT_FIELDS) + ", raw string"
LINKS = f"graph_id string, ord bigint, id string, source string, target string, type string, payload string, source_location {LOCATION}"
EXTERNAL_LINKS = f"graph_id string, ord bigint, id string, source string, target struct<name:string,domain:string,repository:string,url:string>, type string, description string, source_location {LOCATION}"
DOMAINS = "graph_id string, ord bigint, name string, description string, system_type string"
CUSTOM_TYPES = "graph_id string, ord bigint, name string, description string, required map<string,struct<type:string,description:string>>, optional map<string,struct<type:string,description:string>>"
GRAPHS = "graph_id string, version string, metadata string"
DECLARATIONS = (
    "file string, ord bigint, kind string, name string, line int, parent_class string, decorators array<struct<name:string,source:string,args:array<string>,named_args:map<string,string>>>,"
    " jsdoc_tags array<string>, extends string, implements array<struct<text:string,base:string,type_args:array<string>>>, properties array<struct<name:string,is_static:boolean,literal_kind:string,literal:string>>,"
    " parameters array<struct<name:string,type:string>>, ctor_parameters array<struct<name:string,type:string>>, return_type string"
)
