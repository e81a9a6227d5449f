"""Kinds of elements by language."""

from __future__ import annotations

# Kinds (spelled as in selectors) and the node types that each selects. Other kinds are node types themselves.
GO = {
    "function func fn": "function_declaration method_declaration", "struct interface iface": "type_spec", "variable var": "var_declaration short_var_declaration",
    "constant const": "const_declaration", "import": "import_declaration", "type": "type_declaration type_spec", "method": "method_declaration", "field": "field_declaration",
    "call": "call_expression", "assignment assign": "assignment_statement short_var_declaration", "return": "return_statement", "condition if": "if_statement", "block": "block",
    "loop for": "for_statement range_clause", "comment comments": "comment",
}
PYTHON = {
    "function func fn method def": "function_definition async_function_definition", "class cls": "class_definition", "type alias type_alias": "type_alias_statement",
    "variable var": "assignment augmented_assignment global_statement nonlocal_statement", "assignment assign": "assignment augmented_assignment",
    "import": "import_statement import_from_statement", "from": "import_from_statement", "call": "call", "return": "return_statement", "condition": "if_statement match_statement", "if": "if_statement",
    "block": "block", "loop": "for_statement while_statement", "for": "for_statement", "decorator": "decorator", "lambda": "lambda", "comment comments": "comment",
}
JAVASCRIPT = {
    "function func fn": "function_declaration function_expression arrow_function method_definition", "method constructor ctor": "method_definition", "class": "class_declaration class_expression",
    "property prop field": "field_definition", "variable var const let": "variable_declaration lexical_declaration variable_declarator", "lambda arrow": "arrow_function", "array": "array array_pattern",
    "object": "object object_pattern", "import": "import_statement", "export": "export_statement", "call": "call_expression new_expression",
    "assignment assign": "assignment_expression augmented_assignment_expression", "return": "return_statement", "condition": "if_statement switch_statement", "if": "if_statement", "block": "statement_block",
    "loop": "for_statement for_in_statement while_statement do_statement", "for": "for_statement for_in_statement", "interface": "interface_declaration", "type": "type_alias_declaration",
    "decorator": "decorator", "comment comments": "comment",
}
TYPESCRIPT = {
    "function func fn": "function_declaration function_expression arrow_function method_definition method_signature public_field_definition", "class": "class_declaration class_expression",
    "interface iface": "interface_declaration", "type": "type_alias_declaration", "enum": "enum_declaration", "enum_member member": "enum_member",
    "method getter setter accessor": "method_definition method_signature", "constructor ctor": "method_definition",
    "variable var const let": "variable_declaration lexical_declaration variable_declarator", "lambda arrow": "arrow_function", "array": "array array_pattern", "object": "object object_pattern",
    "import": "import_statement", "export": "export_statement", "call": "call_expression new_expression", "assignment assign": "assignment_expression augmented_assignment_expression",
    "return": "return_statement", "condition": "if_statement switch_statement", "if": "if_statement", "block": "statement_block",
    "loop": "for_statement for_in_statement while_statement do_statement", "for": "for_statement for_in_statement", "module": "module_declaration", "namespace": "namespace_declaration",
    "property prop field": "public_field_definition private_field_definition field_definition property_signature",
    "signature": "method_signature function_signature construct_signature index_signature call_signature", "decorator": "decorator", "comment comments": "comment",
}
PHP = {
    "function func fn": "function_definition method_declaration anonymous_function_creation_expression arrow_function", "closure": "anonymous_function_creation_expression",
    "method constructor ctor": "method_declaration", "class": "class_declaration", "interface": "interface_declaration", "trait": "trait_declaration",
    "variable var": "assignment_expression simple_parameter property_declaration variable_name", "assignment assign": "assignment_expression", "property field": "property_declaration",
    "constant const": "const_declaration class_constant_declaration", "namespace": "namespace_definition", "use import": "namespace_use_declaration", "include": "include_expression",
    "include_once": "include_once_expression", "require": "require_expression", "require_once": "require_once_expression",
    "call": "function_call_expression member_call_expression scoped_call_expression", "return": "return_statement", "condition": "if_statement switch_statement", "if": "if_statement",
    "block": "compound_statement declaration_list", "loop": "for_statement foreach_statement while_statement do_statement", "for": "for_statement foreach_statement", "foreach": "foreach_statement",
    "enum": "enum_declaration", "array dict hash map object": "array_creation_expression", "array_element array_item element": "array_element_initializer", "list destructure": "list_literal",
    "comment comments": "comment",
}
#: Spellings that are reported as another kind (fixed values).
CANONICAL = {
    "go": {"func": "function", "fn": "function", "var": "variable", "assign": "assignment"},
    "python": {"func": "function", "fn": "function", "def": "function", "var": "variable"},
    "javascript": {"func": "function", "fn": "function", "var": "variable"},
    "typescript": {"func": "function", "fn": "function", "var": "variable"},
    "php": {"func": "function", "fn": "function", "var": "variable"},
}
LANGUAGES = tuple(CANONICAL)


def kinds(language: str) -> dict[str, tuple[str, ...]]:
    table = {"go": GO, "python": PYTHON, "javascript": JAVASCRIPT, "typescript": TYPESCRIPT, "php": PHP}[language]
    return {kind: tuple(types.split()) for spellings, types in table.items() for kind in spellings.split()}
