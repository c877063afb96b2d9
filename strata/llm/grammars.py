"""Grammars of the parsed languages, for recognition only.

Operator precedence doesn't change what is valid, so binary operators form one flat level; fewer levels mean fewer
reductions a token. ``BOP`` and ``ASG`` are the binary and assigning operators that have no other use in the grammar.
Expressions that may not begin with a brace, or may not hold a brace literal at their outer level, are written once and
expanded for each form (``@`` stands for the form's letter).
"""

import re

JSON = """
Text: Value ;
Value: STR | NUM | 'true' | 'false' | 'null' | '[' ']' | '[' Value % ',' ']' | '{' '}' | '{' (STR ':' Value) % ',' '}' ;
"""

PYTHON = """
File: NL? Line* ;
Line: Simple NL | Compound ;
Simple: Small % ';' ';'? ;
Small: Exprs | Exprs ':' Expr | Exprs ':' Expr '=' Rhs | Exprs ('=' Rhs)+ | Exprs ASG Rhs | 'pass' | 'break' | 'continue' | 'return' Exprs? | 'raise' (Expr ('from' Expr)?)? | 'global' Name % ',' | 'nonlocal' Name % ','
  | 'del' Exprs | 'assert' Expr (',' Expr)? | Import | 'type' Name TypeParams? '=' Expr ;
Rhs: Exprs | 'yield' Exprs? | 'yield' 'from' Expr ;
Import: 'import' (Dotted As?) % ',' | 'from' From 'import' ('*' | (Name As?) % ',' | '(' (Name As?) % ',' ','? ')') ;
From: Dots | Dots Dotted | Dotted ;
Dots: ('.' | '...')+ ;
Dotted: Name % '.' ;
As: 'as' Name ;
Block: Simple NL | NL IN Line+ OUT ;
Compound: 'if' Named ':' Block ('elif' Named ':' Block)* Else? | 'while' Named ':' Block Else? | 'async'? 'for' Targets 'in' Exprs ':' Block Else? | 'async'? 'with' Withs ':' Block
  | 'try' ':' Block (Except+ Else? Finally? | Finally) | Decorator* 'async'? 'def' Name TypeParams? '(' Params? ')' ('->' Expr)? ':' Block | Decorator* 'class' Name TypeParams? ('(' Args? ')')? ':' Block
  | 'match' Exprs ':' NL IN ('case' Patterns ('if' Named)? ':' Block)+ OUT ;
Else: 'else' ':' Block ;
Finally: 'finally' ':' Block ;
Except: 'except' '*'? (Exprs As?)? ':' Block ;
Withs: With % ',' | '(' With % ',' ','? ')' ;
With: Expr ('as' Unary)? ;
Decorator: '@' Named NL ;
TypeParams: '[' TypeParam % ',' ','? ']' ;
TypeParam: ('*' | '**')? Name (':' Expr)? ('=' Expr)? ;
Params: Param % ',' ','? ;
Param: Name (':' Expr)? ('=' Expr)? | '*' | '/' | '*' Name (':' StarExpr)? | '**' Name (':' Expr)? ;
Lambda: 'lambda' (LamParam % ',' ','?)? ':' Expr ;
LamParam: Name ('=' Expr)? | '*' | '/' | '*' Name | '**' Name ;
Exprs: StarExpr % ',' ','? ;
StarExpr: Named | '*' Unary ;
Named: Expr | Name ':=' Expr ;
Expr: Or | Or 'if' Or 'else' Expr | Lambda ;
Or: Not | Or Op Not ;
Not: Unary | 'not' Not ;
Op: BOP | '|' | '*' | '-' | '+' | '**' | '/' | '@' | '<' | '>' | 'or' | 'and' | 'in' | 'not' 'in' | 'is' | 'is' 'not' ;
Unary: Atom | ('-' | '+' | '~' | 'await') Unary ;
Name: NAME | 'match' | 'case' | 'type' ;
Atom: Name | NUM | STR+ | '...' | 'None' | 'True' | 'False' | '(' ')' | '(' Rhs ')' | '(' Named Comp ')' | '[' ']' | '[' Exprs ']' | '[' StarExpr Comp ']' | '{' '}' | '{' Exprs '}' | '{' StarExpr Comp '}' | '{' Pair % ',' ','? '}' | '{' Expr ':' Expr Comp '}'
  | Atom '.' Name | Atom '(' Args? ')' | Atom '[' Subs ']' ;
Subs: Sub % ',' ','? ;
Sub: StarExpr | Expr? ':' Expr? | Expr? ':' Expr? ':' Expr? ;
Pair: Expr ':' Expr | '**' Or ;
Args: Arg % ',' ','? ;
Arg: Named | Named Comp | Name '=' Expr | '*' Expr | '**' Expr ;
Comp: ('async'? 'for' Targets 'in' Or ('if' CompIf)*)+ ;
CompIf: Or | Lambda | Name ':=' Or ;
Targets: Target % ',' ','? ;
Target: Unary | '*' Unary ;
Patterns: Pattern % ',' ','? ;
Pattern: PatOr ('as' Name)? | '*' Name ;
PatOr: Pat | PatOr '|' Pat ;
Pat: '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | Dotted | Dotted '(' (PatArg % ',' ','?)? ')' | '(' ')' | '(' Patterns ')' | '[' Patterns? ']' | '{' (PatKey % ',' ','?)? '}' ;
PatArg: Pattern | Name '=' Pattern ;
PatKey: ('-'? NUM | STR+ | 'None' | 'True' | 'False' | Dotted) ':' Pattern | '**' Name ;
"""

_SCRIPT_EXPR = """
Comma@: Assign@ | Comma@ ',' Assign ;
Assign@: Cond@ | Lhs@ AsgOp Assign | Arrow | 'yield' | 'yield' Assign | 'yield' '*' Assign ;
AsgOp: ASG | '=' ;
Cond@: Bin@ | Bin@ '?' Assign ':' Assign ;
Bin@: Un@ | Bin@ BinOp Un ;
BinOp: BOP | '*' | '/' | '+' | '-' | '<' | '>' | '>' '>' | '>' '>' '>' | '>' '=' | '|' | '&' | 'in' | 'instanceof' ;
Un@: Lhs@ | Lhs@ INC | ('+' | '-' | '!' | '~' | 'typeof' | 'void' | 'delete' | 'await' | INC) Un ;
Lhs@: Prim@ | Lhs@ '.' AnyName | Lhs@ '.' PRIVATE | Lhs@ '?.' AnyName | Lhs@ '?.' '[' Comma ']' | Lhs@ '?.' Args | Lhs@ '[' Comma ']' | Lhs@ Args | Lhs@ Template ;
"""

_SCRIPT = """
Program: Item* ;
Item: Stmt | ImportDecl | ExportDecl ;
End: ';' | ASI ;
ImportDecl: 'import' STR With? End | 'import' ImportClause 'from' STR With? End ;
With: 'with' Object ;
ImportClause: Bind | Bind ',' NameSpace | Bind ',' NamedList | NameSpace | NamedList ;
NameSpace: '*' 'as' Bind ;
NamedList: '{' '}' | '{' Spec % ',' ','? '}' ;
Spec: AnyName | STR | AnyName 'as' AnyName | STR 'as' AnyName | AnyName 'as' STR ;
ExportDecl: 'export' '*' 'from' STR With? End | 'export' '*' 'as' AnyName 'from' STR With? End | 'export' NamedList 'from' STR With? End | 'export' NamedList End | 'export' Declaration | 'export' VarStmt | 'export' 'default' Declaration | 'export' 'default' AssignN End
  | 'export' 'default' Object End | 'export' 'default' 'async'? 'function' '*'? Sig FnBody | 'export' 'default' 'class' ClassTail ;
Stmt: Block | VarStmt | ';' | CommaN End | 'if' '(' Comma ')' Stmt | 'if' '(' Comma ')' Stmt 'else' Stmt | 'do' Stmt 'while' '(' Comma ')' End? | 'while' '(' Comma ')' Stmt | 'for' 'await'? '(' ForHead ')' Stmt | 'continue' Bind? End | 'break' Bind? End
  | 'return' Comma? End | 'throw' Comma End | 'switch' '(' Comma ')' '{' Case* '}' | 'try' Block Catch | Bind ':' Stmt | 'debugger' End | Declaration ;
Case: 'case' Comma ':' Stmt* | 'default' ':' Stmt* ;
Catch: 'catch' CatchParam? Block | 'finally' Block | 'catch' CatchParam? Block 'finally' Block ;
Block: '{' Stmt* '}' ;
VarWord: 'var' | 'let' | 'const' ;
VarStmt: ('var' | 'let') Var % ',' End | 'const' ConstVar % ',' End ;
ForHead: ('var' | 'let') Var % ',' ';' Comma? ';' Comma? | 'const' ConstVar % ',' ';' Comma? ';' Comma? | CommaN ';' Comma? ';' Comma? | ';' Comma? ';' Comma? | VarWord Target 'of' Assign | VarWord Target 'in' Comma | LhsN 'of' Assign ;
Target: Bind | Pattern ;
Pattern: '[' ']' | '[' PatItem % ',' ']' | '{' '}' | '{' PatProp % ',' ','? '}' ;
PatItem: | PatElem | '...' Target ;
PatElem: Target ('=' Assign)? ;
PatProp: Bind ('=' Assign)? | PropName ':' PatElem | '...' Target ;
AnyName: NAME | Word | 'if' | 'in' | 'do' | 'var' | 'for' | 'new' | 'try' | 'this' | 'else' | 'case' | 'void' | 'with' | 'enum' | 'while' | 'break' | 'catch' | 'throw' | 'const' | 'yield' | 'class' | 'super' | 'return' | 'typeof' | 'delete' | 'switch' | 'export' | 'import' | 'default' | 'finally' | 'extends' | 'function' | 'continue' | 'debugger' | 'instanceof' | 'null' | 'true' | 'false' | 'await' ;
PropName: AnyName | STR | NUM | '[' Assign ']' ;
Object: '{' '}' | '{' Prop % ',' ','? '}' ;
Prop: PropName ':' Assign | Bind | Bind '=' Assign | '...' Assign | Method ;
Array: '[' Elems ']' ;
Elems: Elem | Elems ',' Elem ;
Elem: | Assign | '...' Assign ;
Args: '(' ')' | '(' Arg % ',' ','? ')' ;
Arg: Assign | '...' Assign ;
Template: TPL | THEAD Comma (TMID Comma)* TTAIL ;
PrimN: Bind | NUM | STR | REGEX | Template | 'this' | 'super' | 'null' | 'true' | 'false' | Array | Paren | New | 'import' '(' Assign (',' Assign)? ','? ')' | 'import' '.' AnyName | PRIVATE ;
Prim: PrimN | Object | 'async'? 'function' '*'? Bind? Sig FnBody | 'class' Bind? ClassTail ;
New: 'new' NewTarget Args | 'new' NewTarget | 'new' '.' AnyName ;
FnBody: Block ;
Arrow: Bind '=>' ArrowBody | 'async' Bind '=>' ArrowBody ;
ArrowBody: Block | AssignN ;
"""

JAVASCRIPT = (
    _SCRIPT
    + _SCRIPT_EXPR.replace("@", "")
    + _SCRIPT_EXPR.replace("@", "N")
    + """
Word: 'as' | 'from' | 'of' | 'get' | 'set' | 'static' | 'async' | 'let' ;
Bind: NAME | 'as' | 'from' | 'of' | 'get' | 'set' | 'static' | 'async' ;
Var: Bind ('=' Assign)? | Pattern '=' Assign ;
ConstVar: Target '=' Assign ;
CatchParam: '(' Target ')' ;
Sig: '(' ')' | '(' Param % ',' ','? ')' ;
Param: PatElem | '...' Target ;
Paren: '(' Comma ')' ;
Arrow: ParenList '=>' ArrowBody | 'async' ParenList '=>' ArrowBody ;
ParenList: Sig ;
NewTarget: Bind | 'this' | Paren | 'function' '*'? Bind? Sig FnBody | 'class' Bind? ClassTail | NewTarget '.' AnyName | NewTarget '[' Comma ']' | New ;
Declaration: 'async'? 'function' '*'? Bind Sig FnBody | 'class' Bind ClassTail ;
ClassTail: ('extends' Lhs)? '{' Member* '}' ;
Member: ';' | 'static'? Method | 'static'? MemberName ('=' Assign)? End | 'static' Block ;
MemberName: PropName | PRIVATE ;
Method: ('async' | '*' | 'async' '*' | 'get' | 'set')? MemberName Sig FnBody ;
"""
)

TYPESCRIPT = (
    _SCRIPT
    + _SCRIPT_EXPR.replace("@", "")
    + _SCRIPT_EXPR.replace("@", "N")
    + """
Word: 'as' | 'from' | 'of' | 'get' | 'set' | 'static' | 'async' | 'let' | 'type' | 'interface' | 'namespace' | 'module' | 'declare' | 'abstract' | 'readonly' | 'public' | 'private' | 'protected' | 'override' | 'is' | 'keyof' | 'infer' | 'satisfies' | 'asserts' | 'unique' | 'implements' | 'global' ;
Bind: NAME | 'as' | 'from' | 'of' | 'get' | 'set' | 'static' | 'async' | 'type' | 'namespace' | 'module' | 'declare' | 'abstract' | 'readonly' | 'public' | 'private' | 'protected' | 'override' | 'is' | 'keyof' | 'infer' | 'satisfies' | 'asserts' | 'unique' | 'global' ;
ImportDecl: 'import' 'type' ImportClause 'from' STR End | 'import' Bind '=' Bind '(' STR ')' End ;
Spec: 'type' AnyName | 'type' AnyName 'as' AnyName ;
ExportDecl: 'export' 'type' NamedList ('from' STR)? End | 'export' '=' Comma End | 'export' 'as' 'namespace' Bind End | 'export' 'default' 'abstract' 'class' Bind? ClassTail ;
Var: Target '!'? TypeAnn? ('=' Assign)? ;
ConstVar: Bind TypeAnn? '=' Assign | Bind TypeAnn | Pattern TypeAnn? '=' Assign ;
TypeAnn: ':' Type ;
CatchParam: '(' Target TypeAnn? ')' ;
Sig: TypeParams? '(' ')' ReturnAnn? | TypeParams? '(' Param % ',' ','? ')' ReturnAnn? ;
ReturnAnn: ':' Type | ':' Guard ;
Guard: (AnyName | 'this') 'is' Type | 'asserts' (Bind | 'this') ('is' Type)? ;
Param: Decorator* Modifier* (Target | 'this') '?'? TypeAnn? ('=' Assign)? | '...' Target TypeAnn? ;
Modifier: 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'static' | 'abstract' | 'declare' | 'async' ;
Paren: '(' Comma ')' ;
Arrow: Sig '=>' ArrowBody | 'async' Sig '=>' ArrowBody ;
NewTarget: Bind | 'this' | Paren | 'function' '*'? Bind? Sig FnBody | 'class' Bind? ClassTail | NewTarget '.' AnyName | NewTarget '[' Comma ']' | NewTarget TypeArgs | New ;
Bin: Bin ('as' | 'satisfies') (Type | 'const') ;
BinN: BinN ('as' | 'satisfies') (Type | 'const') ;
Lhs: Lhs '!' | Lhs TypeArgs Args ;
LhsN: LhsN '!' | LhsN TypeArgs Args ;
Un: '<' Type '>' Un ;
UnN: '<' Type '>' Un ;
Declaration: Decorator* 'abstract'? 'class' Bind ClassTail | 'async'? 'function' '*'? Bind Sig (FnBody | End) | 'interface' Bind TypeParams? ('extends' Type % ',')? TypeBody | 'type' Bind TypeParams? '=' Type End | 'const'? 'enum' Bind '{' (EnumItem % ',' ','?)? '}'
  | ('namespace' | 'module') (Bind % '.' | STR) '{' Item* '}' | 'declare' Declaration | 'declare' VarWord Var % ',' End | 'declare' 'global' '{' Item* '}' ;
EnumItem: PropName ('=' Assign)? ;
Decorator: '@' Lhs ;
ClassTail: TypeParams? ('extends' Lhs TypeArgs?)? ('implements' Type % ',')? '{' Member* '}' ;
Member: ';' | Decorator* Modifier* Method | Decorator* Modifier* MemberName ('?' | '!')? TypeAnn? ('=' Assign)? End | 'static' Block | Modifier* '[' Bind ':' Type ']' TypeAnn End | Decorator* Modifier* MemberName '?'? Sig End ;
MemberName: PropName | PRIVATE ;
Method: ('async' | '*' | 'async' '*' | 'get' | 'set')? MemberName '?'? Sig FnBody ;
TypeParams: '<' TypeParam % ',' ','? '>' ;
TypeParam: 'const'? Bind ('extends' Type)? ('=' Type)? ;
TypeArgs: '<' Type % ',' '>' ;
Type: UnionType | UnionType 'extends' Type '?' Type ':' Type | TypeParams? '(' (Param % ',' ','?)? ')' '=>' (Type | Guard) | 'abstract'? 'new' TypeParams? '(' (Param % ',' ','?)? ')' '=>' Type ;
UnionType: PostType | '|' PostType | '&' PostType | UnionType ('|' | '&') PostType ;
PostType: PrimType | PostType '[' ']' | PostType '[' Type ']' | ('keyof' | 'unique' | 'infer' | 'readonly') PostType ;
PrimType: TypeName TypeArgs? | '(' Type ')' | TypeBody | '[' ']' | '[' TupleItem % ',' ','? ']' | STR | '-'? NUM | 'null' | 'true' | 'false' | 'void' | 'this' | 'typeof' TypeName | 'import' '(' STR ')' ('.' TypeName)? TypeArgs? | Template | MappedType ;
TypeName: NAME | 'type' | 'namespace' | 'module' | 'declare' | 'async' | 'of' | 'from' | 'get' | 'set' | 'global' | TypeName '.' AnyName ;
TupleItem: Type | Type '?' | '...' Type | AnyName '?'? ':' Type | '...' AnyName ':' Type ;
TypeBody: '{' (TypeMember (';' | ',' | ASI))* TypeMember? '}' ;
TypeMember: 'readonly'? PropName '?'? TypeAnn? | PropName '?'? Sig | Sig | 'new' Sig | 'readonly'? '[' Bind ':' Type ']' TypeAnn | ('get' | 'set') PropName Sig ;
MappedType: '{' (('+' | '-')? 'readonly')? '[' Bind 'in' Type ('as' Type)? ']' (('+' | '-')? '?')? TypeAnn? (';' | ASI)? '}' ;
"""
)

_GO_EXPR = """
Expr@: Un@ | Expr@ Op Un@ ;
Un@: Prim@ | ('+' | '-' | '!' | '^' | '*' | '&' | '<-') Un@ ;
Prim@: Oper@ | Chain | Chain '.' '(' (Type | 'type') ')' | Prim@ '.' NAME | Prim@ '.' '(' (Type | 'type') ')' | Prim@ '[' Index ']' | Prim@ '(' (CallArg % ',' ','?)? ')' ;
"""

GO = (
    """
File: Sep* 'package' NAME ';' (Import ';')* (Top ';')* ;
Sep: ';' ;
Import: 'import' ImportSpec | 'import' '(' (ImportSpec ';')* ImportSpec? ')' ;
ImportSpec: STR | NAME STR | '.' STR ;
Top: Decl | 'func' NAME TypeParams? Signature Block? | 'func' Params NAME Signature Block? ;
Decl: 'const' ValueSpec | 'const' '(' (ValueSpec ';')* ValueSpec? ')' | 'var' VarSpec | 'var' '(' (VarSpec ';')* VarSpec? ')' | 'type' TypeSpec | 'type' '(' (TypeSpec ';')* TypeSpec? ')' ;
ValueSpec: NAME % ',' | NAME % ',' '=' Expr % ',' | NAME % ',' Type '=' Expr % ',' ;
VarSpec: NAME % ',' Type | NAME % ',' '=' Expr % ',' | NAME % ',' Type '=' Expr % ',' ;
TypeSpec: NAME TypeParams? Type | NAME TypeParams? '=' Type ;
TypeParams: '[' TypeParam % ',' ','? ']' ;
TypeParam: NAME % ',' Constraint ;
Constraint: '~'? Type | Constraint '|' '~'? Type ;
Signature: Params | Params Type | Params Params ;
Params: '(' ')' | '(' Param % ',' ','? ')' ;
Param: Type | NAME Type | '...' Type | NAME '...' Type ;
TypeName: NAME | NAME '.' NAME | TypeName '[' Type % ',' ','? ']' ;
Type: TypeName | '(' Type ')' | LitType | '*' Type | 'func' Signature | 'chan' Type | 'chan' '<-' Type | '<-' 'chan' Type | 'interface' '{' (IfaceItem ';')* IfaceItem? '}' ;
LitType: '[' ']' Type | '[' Expr ']' Type | '[' '...' ']' Type | 'map' '[' Type ']' Type | 'struct' '{' (Field ';')* Field? '}' ;
Field: (NAME % ',' Type | '*'? TypeName) STR? ;
IfaceItem: NAME Signature | Constraint ;
Block: '{' StmtList '}' ;
StmtList: Stmt? | StmtList ';' Stmt? ;
Stmt: Decl | SimpleStmt | NAME ':' Stmt | NAME ':' | 'go' Expr | 'defer' Expr | 'return' (Expr % ',')? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | Block | If | Switch | Select | For ;
SimpleStmt: Expr % ',' | Expr % ',' AsgOp Expr % ',' | Expr INC | Expr '<-' Expr ;
Header: ExprH % ',' | ExprH % ',' AsgOp ExprH % ',' | ExprH INC ;
AsgOp: '=' | ':=' | ASG ;
If: 'if' (Header? ';')? Header Block ('else' (If | Block))? ;
Switch: 'switch' (Header? ';')? Header? '{' Case* '}' ;
Case: ('case' CaseItem % ',' | 'default') ':' StmtList ;
CaseItem: Expr | LitType | 'func' Signature | 'chan' Type | 'interface' '{' (IfaceItem ';')* IfaceItem? '}' ;
Select: 'select' '{' (('case' SimpleStmt | 'default') ':' StmtList)* '}' ;
For: 'for' Block | 'for' Header Block | 'for' Header? ';' Header? ';' Header? Block | 'for' (ExprH % ',' AsgOp)? 'range' ExprH Block ;
CallArg: Expr | Expr '...' | LitType | 'chan' Type ;
Index: Expr | Expr? ':' Expr? | Expr? ':' Expr ':' Expr | Expr ',' Type % ',' | LitType ;
Literal: '{' '}' | '{' Elem % ',' ','? '}' ;
Elem: (ElemVal ':')? ElemVal ;
ElemVal: Expr | Literal ;
Op: BOP | '+' | '-' | '*' | '&' | '^' | '|' ;
Chain: NAME | Chain '.' NAME ;
OperH: NUM | STR | CHAR | '(' Expr ')' | '(' ParenType ')' | 'func' Signature Block | LitType Literal | LitType '(' Expr ')' | 'interface' '{' '}' '(' Expr ')' ;
ParenType: LitType | '*' LitType | 'func' Signature | 'chan' Type | '<-' 'chan' Type | 'interface' '{' (IfaceItem ';')* IfaceItem? '}' ;
Oper: OperH | Chain Literal | Prim '[' Index ']' Literal ;
"""
    + _GO_EXPR.replace("@", "")
    + _GO_EXPR.replace("@", "H")
)

JAVA = """
Unit: Package? Import* TypeTop* ;
Package: Ann* 'package' Dotted ';' ;
Import: 'import' 'static'? Dotted ('.' '*')? ';' | ';' ;
TypeTop: TypeDecl | ';' ;
Dotted: Ident % '.' ;
Ident: NAME | 'record' | 'sealed' | 'permits' | 'var' | 'yield' | 'module' | 'non' ;
Ann: '@' Dotted | '@' Dotted '(' ')' | '@' Dotted '(' AnnVal ')' | '@' Dotted '(' (Ident '=' AnnVal) % ',' ')' ;
AnnVal: Cond | Ann | '{' (AnnVal % ',')? ','? '}' ;
Mod: Ann | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed' ;
TypeDecl: Mod* TypeHead ;
TypeHead: 'class' Ident TypeParams? ('extends' Type)? ('implements' Type % ',')? ('permits' Type % ',')? ClassBody | 'interface' Ident TypeParams? ('extends' Type % ',')? ('permits' Type % ',')? ClassBody
  | 'enum' Ident ('implements' Type % ',')? '{' (EnumItem % ',')? ','? (';' Member*)? '}' | '@' 'interface' Ident '{' Member* '}' | 'record' Ident TypeParams? '(' (Param % ',')? ')' ('implements' Type % ',')? ClassBody ;
EnumItem: Ann* Ident ('(' Args? ')')? ClassBody? ;
TypeParams: '<' TypeParam % ',' '>' ;
TypeParam: Ann* Ident ('extends' Type % '&')? ;
ClassBody: '{' Member* '}' ;
Member: ';' | Mod* TypeHead | 'static'? Block | Mod* TypeParams? Type Declr % ',' ';' | Mod* TypeParams? (Type | 'void') Ident Formals Dim* Throws? (Block | ';' | 'default' AnnVal ';') | Mod* TypeParams? Ident Formals Throws? Block | Mod* Ident Block ;
Throws: 'throws' Type % ',' ;
Formals: '(' ')' | '(' Param % ',' ')' ;
Param: Mod* Type '...'? (Ident | 'this' | Ident '.' 'this') Dim* ;
Dim: '[' ']' ;
Type: PRIMITIVE Dim* | ClassType Dim* ;
ClassType: Ann* Ident TypeArgs? | ClassType '.' Ann* Ident TypeArgs? ;
TypeArgs: '<' '>' | '<' TypeArg % ',' '>' ;
TypeArg: Type | Ann* '?' (('extends' | 'super') Type)? ;
Declr: Ident Dim* ('=' Init)? ;
Init: Expr | '{' (Init % ',')? ','? '}' ;
Block: '{' Stmt* '}' ;
LocalVar: ('final' | Ann)* Type Declr % ',' ;
Stmt: Block | ';' | Expr ';' | LocalVar ';' | LocalMod* TypeHead | 'if' '(' Expr ')' Stmt | 'if' '(' Expr ')' Stmt 'else' Stmt | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';' | 'for' '(' ForInit? ';' Expr? ';' (Expr % ',')? ')' Stmt | 'for' '(' ('final' | Ann)* Type Ident ':' Expr ')' Stmt
  | 'return' Expr? ';' | 'break' Ident? ';' | 'continue' Ident? ';' | 'throw' Expr ';' | 'yield' Expr ';' | 'synchronized' '(' Expr ')' Block | 'try' Resources? Block Catch* ('finally' Block)? | SwitchHead | Ident ':' Stmt | 'assert' Expr (':' Expr)? ';' ;
LocalMod: 'final' | 'abstract' | 'static' | 'strictfp' | Ann ;
ForInit: LocalVar | Expr % ',' ;
Resources: '(' Resource % ';' ';'? ')' ;
Resource: ('final' | Ann)* Type Ident '=' Expr | Expr ;
Catch: 'catch' '(' ('final' | Ann)* Type % '|' Ident ')' Block ;
SwitchHead: 'switch' '(' Expr ')' '{' Case* '}' ;
Case: Label (':' | '->') Stmt* ;
Label: 'case' (Cond | Pattern) % ',' | 'default' ;
Pattern: 'final'? Type Ident ;
Expr: Cond | Cond AsgOp Expr | Lambda ;
AsgOp: '=' | ASG | '>' '>' '=' | '>' '>' '>' '=' | '>' '>=' | '>' '>' '>=' ;
Lambda: Ident '->' LambdaBody | '(' ')' '->' LambdaBody | '(' (Ident % ',') ')' '->' LambdaBody | '(' (Param % ',') ')' '->' LambdaBody ;
LambdaBody: Expr | Block ;
Cond: Bin | Bin '?' Expr ':' (Cond | Lambda) ;
Bin: Un | Bin Op Un | Bin 'instanceof' (Type | Pattern) ;
Op: BOP | '+' | '-' | '*' | '/' | '<' | '>' | '>' '>' | '>' '>' '>' | '>=' | '&' | '|' ;
Un: Post | ('+' | '-' | '!' | '~' | INC) Un | Cast ;
Cast: '(' PRIMITIVE Dim* ')' Un | '(' ClassType ('&' ClassType)* Dim* ')' (NoSign | Lambda) ;
NoSign: Post | ('!' | '~') Un | Cast ;
Post: Prim | Post INC ;
Prim: LIT | NUM | STR | CHAR | 'this' | 'super' | '(' Expr ')' | Ident | Prim '.' Ident | Prim '.' 'this' | Prim '.' 'class' | Prim '.' 'super' | Prim '.' TypeArgs Ident '(' Args? ')' | Ident '(' Args? ')' | 'this' '(' Args? ')' | 'super' '(' Args? ')' | Prim '.' Ident '(' Args? ')' | Prim '[' Expr ']'
  | 'new' TypeArgs? ClassType '(' Args? ')' ClassBody? | Prim '.' 'new' ClassType '(' Args? ')' ClassBody? | 'new' (ClassType | PRIMITIVE) ArrayDims | 'new' (ClassType | PRIMITIVE) Dim+ '{' (Init % ',')? ','? '}' | SwitchHead | PRIMITIVE Dim* '.' 'class' | 'void' '.' 'class' | ClassType Dim+ '.' 'class' | Prim '::' (Ident | 'new') | PRIMITIVE Dim* '::' 'new' | ClassType Dim+ '::' 'new' ;
ArrayDims: ('[' Expr ']')+ Dim* ;
Args: Expr % ',' ;
"""

C = """
Unit: Ext* ;
Ext: ';' | Decl | Specs Pointer* DirDeclr '(' Params? ')' Block ;
Decl: Specs ';' | Specs InitDeclr % ',' ';' | '_Static_assert' '(' Cond (',' STR+)? ')' ';' ;
Specs: Mark* Base Mark* | Mark* WORD (WORD | Mark)* ;
Mark: STORAGE | 'static' | Qual | '_Alignas' '(' (Cond | TypeName) ')' | Attr ;
Base: NAME | Struct | Enum | 'typeof' '(' (Expr | TypeName) ')' | '_Atomic' '(' TypeName ')' ;
Attr: '__attribute__' '(' '(' (AttrItem % ',')? ')' ')' ;
AttrItem: (NAME | WORD | 'const' | 'static' | STORAGE) ('(' (Cond % ',')? ')')? ;
Struct: ('struct' | 'union') Attr* NAME | ('struct' | 'union') Attr* NAME? '{' Member* '}' ;
Member: Specs ';' | Specs (Declr? ':' Cond | Declr (':' Cond)?) % ',' Attr* ';' | '_Static_assert' '(' Cond (',' STR+)? ')' ';' | ';' ;
Enum: 'enum' NAME | 'enum' NAME? '{' (NAME ('=' Cond)?) % ',' ','? '}' ;
InitDeclr: Declr Attr* ('=' Init)? ;
Declr: Pointer* DirDeclr ;
Pointer: '*' Qual* ;
Qual: 'const' | 'volatile' | 'restrict' | '_Atomic' ;
DirDeclr: NAME | '(' Declr ')' | DirDeclr '[' Bound ']' | DirDeclr '(' Params? ')' ;
Bound: | '*' | 'static'? Qual* Cond | Qual+ 'static' Cond ;
Params: Param % ',' | Param % ',' ',' '...' ;
Param: Specs | Specs Declr | Specs AbsDeclr ;
AbsDeclr: Pointer+ | Pointer* DirAbs ;
DirAbs: '(' AbsDeclr ')' | '[' Bound ']' | '(' Params? ')' | DirAbs '[' Bound ']' | DirAbs '(' Params? ')' ;
TypeName: Specs AbsDeclr? ;
Init: Assign | '{' '}' | '{' ((Designator+ '=')? Init) % ',' ','? '}' ;
Designator: '[' Cond ('...' Cond)? ']' | '.' NAME ;
Block: '{' Item* '}' ;
Item: Decl | Stmt ;
Stmt: Block | ';' | Expr ';' | NAME ':' Stmt | 'case' Cond ('...' Cond)? ':' Stmt | 'default' ':' Stmt | 'if' '(' Expr ')' Stmt | 'if' '(' Expr ')' Stmt 'else' Stmt | 'switch' '(' Expr ')' Stmt | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';'
  | 'for' '(' Expr? ';' Expr? ';' Expr? ')' Stmt | 'for' '(' Decl Expr? ';' Expr? ')' Stmt | 'goto' NAME ';' | 'continue' ';' | 'break' ';' | 'return' Expr? ';' | Asm ;
Asm: 'asm' Qual* '(' STR+ (':' (AsmItem % ',')?)* ')' ';' ;
AsmItem: ('[' NAME ']')? STR+ ('(' Expr ')')? ;
Expr: Assign % ',' ;
Assign: Cond | Cond AsgOp Assign ;
AsgOp: ASG | '=' ;
Cond: Bin | Bin '?' Expr? ':' Cond ;
Bin: Cast | Bin Op Cast ;
Op: BOP | '*' | '&' | '+' | '-' ;
Cast: Un | '(' TypeName ')' Cast ;
Un: Post | INC Un | ('&' | '*' | '+' | '-' | '~' | '!') Cast | 'sizeof' Un | 'sizeof' '(' TypeName ')' | '_Alignof' '(' TypeName ')' ;
Post: Prim | Post '[' Expr ']' | Post '(' (Assign % ',')? ')' | Post '.' NAME | Post '->' NAME | Post INC | '(' TypeName ')' '{' (((Designator+ '=')? Init) % ',' ','?)? '}' ;
Prim: NAME | NUM | CHAR | STR+ | '(' Expr ')' | '_Generic' '(' Assign (',' (TypeName | 'default') ':' Assign)+ ')' | '(' Block ')' ;
"""

_RUST_EXPR = """
Expr@: Rng@ | Rng@ AsgOp Expr@ | Jump@ | Closure@ ;
Jump@: 'return' | 'return' Expr@ | 'break' LIFE? | 'break' LIFE? Expr@ | 'continue' LIFE? ;
Closure@: 'static'? 'async'? 'move'? ('||' | '|' (ClosureParam % ',' ','?)? '|') (Expr@ | '->' TypeNoBounds Block) ;
Rng@: Bin@ | Bin@ RangeOp | Bin@ RangeOp Bin@ | RangeOp Bin@ | '..' ;
Bin@: Un@ | Bin@ Op Un@ | Bin@ 'as' TypeNoBounds ;
Un@: Post@ | ('-' | '!' | '*') Un@ | '&' 'mut'? Un@ | '&&' 'mut'? Un@ | '&' 'raw' ('const' | 'mut') Un@ ;
Post@: Prim@ | Post@ '?' | Post@ '.' Ident | Post@ '.' NUM | Post@ '.' 'await' | Post@ '.' Ident '::' GenericArgs | Post@ '(' (Expr % ',' ','?)? ')' | Post@ '[' Expr ']' ;
"""

RUST = (
    """
File: InnerAttr* Item* ;
InnerAttr: '#' '!' '[' Tree* ']' ;
Attr: '#' '[' Tree* ']' ;
Tree: ANYTOK | '(' Tree* ')' | '[' Tree* ']' | '{' Tree* '}' ;
Item: Attr* Vis? ItemKind | Attr* MacroItem ;
Vis: 'pub' | 'pub' '(' ('crate' | 'self' | 'super' | 'in' SimplePath) ')' | 'crate' ;
MacroItem: SimplePath '!' Ident? ('(' Tree* ')' ';' | '[' Tree* ']' ';' | '{' Tree* '}') ;
ItemKind: 'mod' Ident (';' | '{' InnerAttr* Item* '}') | 'unsafe' 'mod' Ident (';' | '{' InnerAttr* Item* '}') | 'extern' 'crate' (Ident | 'self') ('as' Ident)? ';' | 'use' UseTree ';' | Fn | 'type' Ident Generics? (':' Bounds?)? Where? ('=' Type Where?)? ';' | 'struct' Ident Generics? Where? (';' | '{' (FieldDef % ',' ','?)? '}') | 'struct' Ident Generics? '(' (TupleField % ',' ','?)? ')' Where? ';'
  | 'enum' Ident Generics? Where? '{' (Variant % ',' ','?)? '}' | 'union' Ident Generics? Where? '{' (FieldDef % ',' ','?)? '}' | 'const' (Ident | '_') ':' Type ('=' Expr)? ';' | 'static' 'mut'? Ident ':' Type ('=' Expr)? ';'
  | 'unsafe'? 'auto'? 'trait' Ident Generics? (':' Bounds?)? Where? '{' InnerAttr* Item* '}' | 'unsafe'? 'impl' Generics? ('const'? '!'? Type 'for')? Type Where? '{' InnerAttr* Item* '}' | 'unsafe'? 'extern' STR? '{' InnerAttr* Item* '}' | 'macro_rules' '!' Ident ('{' Tree* '}' | '(' Tree* ')' ';' | '[' Tree* ']' ';') ;
Fn: FnQual* 'fn' Ident Generics? '(' (FnParam % ',' ','?)? ')' ('->' Type)? Where? (';' | Block) ;
FnQual: 'const' | 'async' | 'unsafe' | 'extern' STR? | 'default' ;
FnParam: Attr* (Pattern ':' Type | SelfParam | Pattern ':' '...' | '...') ;
SelfParam: '&'? LIFE? 'mut'? 'self' (':' Type)? ;
FieldDef: Attr* Vis? Ident ':' Type ;
TupleField: Attr* Vis? Type ;
Variant: Attr* Vis? Ident ('(' (TupleField % ',' ','?)? ')' | '{' (FieldDef % ',' ','?)? '}')? ('=' Expr)? ;
UseTree: UsePath? '::'? '*' | UsePath? '{' (UseTree % ',' ','?)? '}' | SimplePath | SimplePath 'as' (Ident | '_') ;
UsePath: SimplePath '::' | '::' ;
SimplePath: '::'? PathSeg | SimplePath '::' PathSeg ;
PathSeg: Ident | 'crate' | 'self' | 'super' | 'Self' ;
Ident: NAME | 'union' | 'auto' | 'default' | 'raw' | 'macro_rules' ;
Generics: '<' (GenericParam % ',' ','?)? '>' ;
GenericParam: Attr* (LIFE (':' LifeBounds?)? | Ident (':' Bounds?)? ('=' Type)? | 'const' Ident ':' Type ('=' ConstArg)?) ;
ConstArg: Block | '-'? NUM | STR | CHAR | 'true' | 'false' | Ident ;
LifeBounds: LIFE % '+' ;
Where: 'where' (WherePred % ',' ','?)? ;
WherePred: LIFE ':' LifeBounds? | ForLife? Type ':' Bounds? ;
ForLife: 'for' '<' (LIFE % ',' ','?)? '>' ;
Bounds: Bound % '+' ;
Bound: LIFE | '?'? ForLife? TypePath | '(' '?'? ForLife? TypePath ')' ;
Type: TypeNoBounds | TypePath '+' Bounds | ('impl' | 'dyn') Bound '+' Bounds ;
TypeNoBounds: '(' ')' | '(' Type ')' | '(' Type ',' ')' | '(' Type (',' Type)+ ','? ')' | '!' | '_' | '[' Type ']' | '[' Type ';' Expr ']' | '&' LIFE? 'mut'? TypeNoBounds | '&&' LIFE? 'mut'? TypeNoBounds | '*' ('const' | 'mut') TypeNoBounds | TypePath | ('impl' | 'dyn') Bound | ForLife? FnQual* 'fn' '(' (BareParam % ',' ','?)? ')' ('->' TypeNoBounds)? | QPath | SimplePath '!' '(' Tree* ')' ;
BareParam: Type | (Ident | '_') ':' Type | '...' ;
QPath: '<' Type ('as' TypePath)? '>' ('::' TypeSeg)+ ;
TypePath: '::'? TypeSeg | TypePath '::' TypeSeg ;
TypeSeg: PathSeg | PathSeg '::'? GenericArgs | PathSeg '(' (Type % ',' ','?)? ')' ('->' TypeNoBounds)? ;
GenericArgs: '<' (GenericArg % ',' ','?)? '>' ;
GenericArg: Type | LIFE | Block | '-'? NUM | STR | CHAR | 'true' | 'false' | Ident GenericArgs? '=' Type | Ident GenericArgs? ':' Bounds ;
Pattern: '|'? PatOne % '|' ;
PatOne: '_' | '..' | ('ref')? 'mut'? Ident ('@' PatOne)? | 'ref' 'mut' Ident ('@' PatOne)? | PatLit | PatLit RangeOp PatLit? | RangeOp PatLit | '&' 'mut'? PatOne | '&&' 'mut'? PatOne | '(' (Pattern % ',' ','?)? ')' | '[' (Pattern % ',' ','?)? ']' | ExprPath '{' (PatField % ',' ','?)? '}' | ExprPath '(' (Pattern % ',' ','?)? ')' | SimplePath '!' '(' Tree* ')' | 'box' PatOne ;
PatLit: '-'? NUM | STR | CHAR | 'true' | 'false' | LongPath ;
PatField: Attr* (Ident ':' Pattern | NUM ':' Pattern | 'ref'? 'mut'? Ident | '..') ;
RangeOp: '..' | '..=' ;
LongPath: ExprPath '::' ExprSeg | '::' ExprSeg | 'crate' | 'self' | 'super' | 'Self' | QPath ;
ExprPath: ExprSeg | '::' ExprSeg | ExprPath '::' ExprSeg | QPath ;
ExprSeg: PathSeg | PathSeg '::' GenericArgs ;
Block: '{' InnerAttr* BlockItem* Expr? '}' ;
BlockItem: ';' | Attr* Vis? ItemKind | Attr* 'let' Pattern (':' Type)? ('=' Expr ('else' Block)?)? ';' | Expr ';' | WithBlock | MacroStmt ;
MacroStmt: SimplePath '!' '{' Tree* '}' ;
WithBlock: Label? 'unsafe' Block | 'async' 'move'? Block | Label? Block | Label? 'loop' Block | Label? 'while' Cond Block | Label? 'for' Pattern 'in' ExprH Block | If | 'match' ExprH '{' InnerAttr* MatchArms '}' | 'const' Block ;
MatchArms: | Arm+ LastArm? | LastArm ;
Arm: ArmHead WithBlock ','? | ArmHead Expr ',' ;
LastArm: ArmHead Expr ;
ArmHead: Attr* Pattern ('if' Cond)? '=>' ;
Label: LIFE ':' ;
If: 'if' Cond Block ('else' (Block | If))? ;
Cond: ExprH | CondLet | Cond '&&' CondLet | CondLet '&&' ExprH ;
CondLet: 'let' Pattern '=' BinH ;
ClosureParam: Attr* PatOne (':' Type)? ;
Op: BOP | '+' | '-' | '*' | '&' | '|' | '&&' | '||' | '<' | '>' | '>' '>' ;
AsgOp: '=' | ASG | '>' '>=' ;
PrimH: NUM | STR | CHAR | 'true' | 'false' | ExprPath | '(' ')' | '(' Expr ')' | '(' Expr ',' ')' | '(' Expr (',' Expr)+ ','? ')' | '[' (Expr % ',' ','?)? ']' | '[' Expr ';' Expr ']' | WithBlock | SimplePath '!' ('(' Tree* ')' | '[' Tree* ']') ;
Prim: PrimH | ExprPath '{' (FieldInit % ',' ','?)? ('..' Expr?)? '}' | MacroStmt ;
FieldInit: Attr* (Ident ':' Expr | NUM ':' Expr | Ident) ;
"""
    + _RUST_EXPR.replace("@", "")
    + _RUST_EXPR.replace("@", "H")
)

#: A macro's token tree may hold every token but brackets.
RUST = RUST.replace("ANYTOK", " | ".join(dict.fromkeys(t for t in re.findall(r"'[^']+'|\b[A-Z]{3,}\b", RUST) if t not in ("'('", "')'", "'['", "']'", "'{'", "'}'", "ANYTOK"))))
