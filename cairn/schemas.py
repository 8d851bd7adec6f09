"""Table schemas of the code graph. Keys are (repo_id, id) everywhere."""

NODE_ATTRIBUTES = "struct<decorators:array<string>,args:map<string,string>,arg_names:array<string>,returns:string,is_async:boolean,bases:array<string>,meta:string>"
EDGE_ATTRIBUTES = "struct<module:string,bindings:array<struct<name:string,alias:string>>,is_relative:boolean,level:int,source_file:string>"
NODE = (
    "id:string,name:string,type:string,language:string,path:string,qualified_name:string,start_line:int,end_line:int,start_byte:int,"
    f"end_byte:int,raw_source:string,summary:string,attributes:{NODE_ATTRIBUTES},node_seq:int"
)
EDGE = f"id:string,source_id:string,target_id:string,target_ref:string,type:string,attributes:{EDGE_ATTRIBUTES},path:string,edge_seq:int"
#: One row a file: what was read from it, or why it couldn't be read.
EXTRACTED = f"repo_id string, path string, nodes array<struct<{NODE}>>, edges array<struct<{EDGE}>>, error string"

NODE_TYPES = ("function", "class", "file", "module")
EDGE_TYPES = ("calls", "imports", "defines", "inherits")
