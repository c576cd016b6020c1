"""Table schemas. Order-sensitive payloads stay JSON strings: a VARIANT would sort keys and reformat numbers."""

TOOL_CALL = "struct<id:string,type:string,name:string,arguments:string>"
MESSAGE = f"struct<role:string,content:string,reasoning_content:string,tool_calls:array<{TOOL_CALL}>,tool_call_id:string,name:string,is_error:boolean,extras:string>"
TRAIN_ROW = (
    f"source_file string, source_line int, trace_type string, prompt string, system string, messages array<{MESSAGE}>, "
    "tools array<struct<name:string,description:string,parameters:string,raw:string>>, metadata string, category string"
)
SPAN = "struct<start:int,end:int,kind:string,role:string>"
REPORT = "raw_index bigint, row_id string, status string, reason string, token_length int, final_token_length int, max_length int, policy string, unsupported_tool string"
KINDS = ("reasoning", "final_answer", "tool_call", "tool_response", "user", "system", "developer")
