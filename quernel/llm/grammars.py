"""Grammars of six languages for the recogniser in ``gll``. Precedence does not matter to a recogniser, so operands and
operators stand in flat lists. Terminals in capitals are token classes."""

PYTHON = r"""
file = stmt* END ;
stmt = line | compound ;
line = small (';' small)* ';'? NEWLINE ;
small = expr_stmt | 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' (expr ('from' expr)?)? | 'global' name (',' name)* | 'nonlocal' name (',' name)*
  | 'del' target (',' target)* ','? | 'assert' expr (',' expr)? | 'import' dotted ('as' name)? (',' dotted ('as' name)?)*
  | 'from' ('.' | '...')* dotted? 'import' ('*' | imported (',' imported)* | '(' imported (',' imported)* ','? ')') | 'type' name type_params? '=' expr ;
imported = name ('as' name)? ;
dotted = name ('.' name)* ;
expr_stmt = exprs | target AUG (yields | exprs) | (targets '=')+ (yields | exprs) | target ':' expr ('=' (yields | exprs))? | yields ;
targets = star_target (',' star_target)* ','? ;
star_target = '*'? target ;
target = atom_target | primary_target ;
atom_target = name | '(' targets? ')' | '[' targets? ']' ;
primary_target = atom trailer* ('.' name | '[' subs ']') ;
yields = 'yield' ('from' expr | exprs)? ;
exprs = star_expr (',' star_expr)* ','? ;
star_expr = '*' flat | expr ;
named = expr | name ':=' expr ;
expr = 'lambda' lambda_params? ':' expr | flat ('if' flat 'else' expr)? ;
flat = operand (binop operand)* ;
binop = BINOP | '*' | '**' | '-' | '+' | '@' | '|' | '/' | 'and' | 'or' | 'in' | 'not' 'in' | 'is' 'not'? ;
operand = ('not' | '-' | '+' | '~' | 'await')* primary ;
primary = atom trailer* ;
trailer = '.' name | '(' args? ')' | '[' subs ']' ;
subs = sub (',' sub)* ','? ;
sub = named | '*' flat | expr? ':' expr? (':' expr?)? ;
args = arg (',' arg)* ','? ;
arg = '*' expr | '**' expr | name '=' expr | named comp? ;
comp = ('async'? 'for' targets 'in' flat ('if' no_cond)*)+ ;
no_cond = flat | 'lambda' lambda_params? ':' no_cond ;
atom = name | NUM | STR+ | '...' | 'None' | 'True' | 'False' | '(' (yields | items_or_comp)? ')' | '[' items_or_comp? ']' | '{' (items_or_comp | dict)? '}' ;
items_or_comp = item comp | item (',' item)* ','? ;
item = named | '*' flat ;
dict = pair comp | pair (',' pair)* ','? ;
pair = expr ':' expr | '**' flat ;
name = ID | 'match' | 'case' | 'type' | '_' ;
lambda_params = lparam (',' lparam)* ','? ;
lparam = name ('=' expr)? | '*' name? | '**' name | '/' ;
params = param (',' param)* ','? ;
param = name (':' expr)? ('=' expr)? | '*' (name (':' star_expr)?)? | '**' name (':' expr)? | '/' ;
type_params = '[' type_param (',' type_param)* ','? ']' ;
type_param = ('*' | '**')? name (':' expr)? ('=' star_expr)? ;
block = NEWLINE INDENT stmt+ DEDENT | line ;
compound = 'if' named ':' block ('elif' named ':' block)* else? | 'while' named ':' block else? | 'async'? 'for' targets 'in' exprs ':' block else? | try
  | 'async'? 'with' (withs | '(' withs ','? ')') ':' block | decorator* (def | class) | match ;
else = 'else' ':' block ;
try = 'try' ':' block (('except' '*'? (expr (',' expr)* ('as' name)?)? ':' block)+ else? ('finally' ':' block)? | 'finally' ':' block) ;
withs = with (',' with)* ;
with = expr ('as' star_target)? ;
decorator = '@' named NEWLINE ;
def = 'async'? 'def' name type_params? '(' params? ')' ('->' expr)? ':' block ;
class = 'class' name type_params? ('(' args? ')')? ':' block ;
match = 'match' exprs ':' NEWLINE INDENT case+ DEDENT ;
case = 'case' patterns ('if' named)? ':' block ;
patterns = pattern (',' pattern)* ','? ;
pattern = '*' name | or_pattern ('as' name)? ;
or_pattern = closed ('|' closed)* ;
closed = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | dotted ('(' (pat_arg (',' pat_arg)* ','?)? ')')? | '(' patterns? ')' | '[' patterns? ']'
  | '{' (map_pat (',' map_pat)* ','?)? '}' ;
pat_arg = pattern | name '=' pattern ;
map_pat = closed ':' pattern | '**' name ;
"""

_JS_COMMON = r"""
file = item* END ;
block = '{' stmt* '}' ;
semi = ';' | ASI ;
list = expr (',' expr)* ;
export_list = '{' (export_name (',' export_name)* ','?)? '}' ;
export_name = TYPE_MARK? (word | STR) ('as' (word | STR))? ;
from = 'from' STR (('with' | 'assert') object)? ;
import = 'import' TYPE_MARK? (STR (('with' | 'assert') object)? | (ident (',' (ns | export_list))? | ns | export_list) from) semi ;
ns = '*' 'as' ident ;
stmt = block | ';' | 'if' '(' list ')' stmt ('else' stmt)? | 'for' 'await'? '(' for_head ')' stmt | 'while' '(' list ')' stmt | 'do' stmt 'while' '(' list ')' (';' | ASI)?
  | 'continue' ident? semi | 'break' ident? semi | 'return' list? semi | 'throw' list semi | 'try' block ('catch' ('(' catch_param ')')? block)? ('finally' block)?
  | 'switch' '(' list ')' '{' (('case' list | 'default') ':' stmt*)* '}' | 'debugger' semi | ident ':' stmt | list0 semi | decl ;
var = ('var' | 'let' | 'const') binding (',' binding)* ;
for_head = (var | list)? ';' list? ';' list? | (('var' | 'let' | 'const' | 'using') pattern | lhs) ('in' list | 'of' expr) ;
list0 = expr0 (',' expr)* ;
expr = arrow | 'yield' '*'? expr? | lhs ASSIGN expr | lhs '=' expr | cond ;
expr0 = arrow | 'yield' '*'? expr? | lhs0 ASSIGN expr | lhs0 '=' expr | cond0 ;
cond = bin ('?' expr ':' expr)? ;
cond0 = bin0 ('?' expr ':' expr)? ;
binop = BINOP | '*' | '<' | '>' | '-' | '+' | '&' | '|' | 'in' | 'instanceof' | '/' | '>' '>' | '>' '>' '>' ;
unop = '!' | '~' | '-' | '+' | 'typeof' | 'void' | 'delete' | 'await' | INC | PREINC ;
lhs = member ;
lhs0 = member0 ;
member = primary suffix* ;
member0 = primary0 suffix* ;
primary = primary0 | object | fn | class_expr ;
primary0 = ident | 'this' | 'super' | NUM | STR | TEMPLATE | REGEX | 'null' | 'true' | 'false' | array | '(' list ')' | new | 'import' '(' list ','? ')' | 'import' '.' word | PRIVATE 'in' member ;
new = 'new' ('.' word | new_target) ;
array = '[' (','* element (','+ element)*)? ','* ']' ;
element = expr | '...' expr ;
args = '(' (arg (',' arg)* ','?)? ')' ;
arg = expr | '...' expr ;
object = '{' (prop (',' prop)* ','?)? '}' ;
prop_name = word | STR | NUM | '[' expr ']' | PRIVATE ;
word = ident | RESERVED | 'if' | 'else' | 'for' | 'while' | 'do' | 'continue' | 'break' | 'return' | 'throw' | 'try' | 'catch' | 'finally' | 'switch' | 'case' | 'default' | 'debugger' | 'var' | 'let' | 'const' | 'in' | 'instanceof'
  | 'typeof' | 'void' | 'delete' | 'await' | 'yield' | 'this' | 'super' | 'null' | 'true' | 'false' | 'new' | 'import' | 'export' | 'function' | 'class' | 'extends' | 'with' | 'enum' | 'static' ;
obj_pattern = '{' (obj_item (',' obj_item)* ','?)? '}' ;
obj_item = ident ('=' expr)? | prop_name ':' pattern ('=' expr)? | '...' pattern ;
arr_pattern = '[' (','* pat_element (','+ pat_element)*)? ','* ']' ;
pat_element = pattern ('=' expr)? | '...' pattern ;
pattern = ident | obj_pattern | arr_pattern ;
"""

JAVASCRIPT = (
    _JS_COMMON.replace("TYPE_MARK? ", "")
    + r"""
ident = ID | 'of' | 'from' | 'as' | 'get' | 'set' | 'async' | 'accessor' | 'using' | 'assert' ;
item = import | decorator* export | stmt ;
export = 'export' ('*' ('as' (word | STR))? from semi | export_list from? semi | var semi | fn_decl | class_decl | 'default' (fn_decl0 | class_decl0 | expr semi)) ;
decl = var semi | fn_decl | class_decl ;
binding = pattern ('=' expr)? ;
catch_param = pattern ;
fn_decl = 'async'? 'function' '*'? ident params block ;
fn_decl0 = 'async'? 'function' '*'? ident? params block ;
fn = 'async'? 'function' '*'? ident? params block ;
params = '(' (param (',' param)* ','?)? ')' ;
param = pattern ('=' expr)? | '...' pattern ;
arrow = 'async'? (ident | params) '=>' (block | expr) ;
class_decl = decorator* 'class' ident heritage? class_body ;
class_decl0 = decorator* 'class' ident? heritage? class_body ;
class_expr = decorator* 'class' ident? heritage? class_body ;
decorator = '@' member ;
heritage = 'extends' member ;
class_body = '{' class_item* '}' ;
class_item = ';' | decorator* 'static'? ('async'? '*'? prop_name params block | 'get' prop_name params block | 'set' prop_name params block | 'accessor'? prop_name ('=' expr)? semi) | 'static' block ;
prop = ident ('=' expr)? | prop_name ':' expr | 'async'? '*'? prop_name params block | 'get' prop_name params block | 'set' prop_name params block | '...' expr ;
bin = unary (binop unary)* ;
bin0 = unary0 (binop unary)* ;
unary = unop* member INC? ;
unary0 = unop+ member INC? | member0 INC? ;
suffix = '.' (word | PRIVATE) | '?.' (word | PRIVATE | args | '[' list ']') | '[' list ']' | args | TEMPLATE ;
new_target = 'new' new_target | primary ('.' (word | PRIVATE) | '[' list ']' | TEMPLATE)* args? ;
"""
)

TYPESCRIPT = (
    _JS_COMMON.replace("TYPE_MARK? ", "'type'? ")
    + r"""
ident = ID | 'of' | 'from' | 'as' | 'get' | 'set' | 'async' | 'accessor' | 'using' | 'assert' | 'require' | 'type' | 'is' | 'keyof' | 'readonly' | 'abstract' | 'declare' | 'namespace' | 'module' | 'interface' | 'asserts' | 'infer' | 'satisfies' | 'override' | 'public' | 'private' | 'protected' | 'unique' | 'out' | 'implements' | 'package' | 'global' ;
item = import | decorator* export | 'import' 'type'? ident '=' ('require' '(' STR ')' | dotted) semi | stmt ;
export = 'export' ('*' ('as' (word | STR))? from semi | 'type' '*' ('as' word)? from semi | 'type'? export_list from? semi | decl | 'default' (fn_decl0 | decorator* 'abstract'? class_decl0 | interface | expr semi) | '=' list semi | 'as' 'namespace' ident semi | 'import' ident '=' dotted semi) ;
dotted = word ('.' word)* ;
decl = 'declare'? (var semi | fn_decl | decorator* 'abstract'? class_decl | interface | 'type' ident tparams? '=' type semi | 'const'? 'enum' ident '{' (enum_item (',' enum_item)* ','?)? '}' | ('namespace' | 'module') (dotted | STR) (ns_body | semi) | 'global' ns_body) ;
ns_body = '{' item* '}' ;
enum_item = prop_name ('=' expr)? ;
interface = 'interface' ident tparams? ('extends' type_ref (',' type_ref)*)? obj_type ;
binding = pattern '!'? annot? ('=' expr)? ;
catch_param = pattern annot? ;
annot = ':' type ;
ret = ':' (type | 'asserts'? (ident | 'this') ('is' type)?) ;
fn_decl = 'async'? 'function' '*'? ident sig (block | semi) ;
fn_decl0 = 'async'? 'function' '*'? ident? sig (block | semi) ;
fn = 'async'? 'function' '*'? ident? sig block ;
sig = tparams? params ret? ;
params = '(' (param (',' param)* ','?)? ')' ;
param = decorator* modifier* (pattern | 'this') '?'? annot? ('=' expr)? | decorator* '...' pattern annot? ;
modifier = 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'static' | 'abstract' | 'declare' | 'accessor' | 'async' ;
arrow = 'async'? (ident | tparams? params ret?) '=>' (block | expr) ;
class_decl = decorator* 'class' ident tparams? heritage* class_body ;
class_decl0 = decorator* 'class' ident? tparams? heritage* class_body ;
class_expr = decorator* 'class' ident? tparams? heritage* class_body ;
decorator = '@' member ;
heritage = 'extends' member targs? | 'implements' type_ref (',' type_ref)* ;
class_body = '{' class_item* '}' ;
class_item = ';' | decorator* modifier* ('*'? prop_name '?'? sig (block | semi) | ('get' | 'set') prop_name sig (block | semi) | prop_name ('?' | '!')? annot? ('=' expr)? semi | index_sig semi) | 'static' block ;
index_sig = '[' ident ':' type ']' annot? ;
prop = ident ('=' expr)? | prop_name ':' expr | 'async'? '*'? prop_name sig block | ('get' | 'set') prop_name sig block | '...' expr ;
bin = unary rest* ;
bin0 = unary0 rest* ;
rest = binop unary | ('as' | 'satisfies') ('const' | type) ;
unary = unop* ('<' ('const' | type) '>')? member INC? ;
unary0 = unop+ ('<' ('const' | type) '>')? member INC? | '<' ('const' | type) '>' member INC? | member0 INC? ;
suffix = '.' (word | PRIVATE) | '?.' (word | PRIVATE | targs? args | '[' list ']') | '[' list ']' | args | TEMPLATE | '!' | targs (args | TEMPLATE)? ;
new_target = 'new' new_target | primary ('.' (word | PRIVATE) | '[' list ']' | TEMPLATE | '!')* targs? args? ;
tparams = '<' tparam (',' tparam)* ','? '>' ;
tparam = ('const' | 'in' | 'out')* ident ('extends' type)? ('=' type)? ;
targs = '<' type (',' type)* '>' ;
type = 'abstract'? 'new' tparams? params '=>' type | tparams? params '=>' ret_type | union ('extends' union '?' type ':' type)? ;
ret_type = type | 'asserts'? (ident | 'this') 'is' type | 'asserts' (ident | 'this') ;
union = ('|' | '&')? type_op (('|' | '&') type_op)* ;
type_op = ('keyof' | 'readonly' | 'unique' | 'infer')* type_post ;
type_post = type_atom ('[' type? ']')* ;
type_atom = type_ref | 'this' | 'void' | 'null' | 'true' | 'false' | STR | '-'? NUM | TEMPLATE | obj_type | '[' (tuple_item (',' tuple_item)* ','?)? ']' | '(' type ')' | 'typeof' (dotted | 'import' '(' STR ')' ('.' word)*) targs? | 'import' '(' STR ')' ('.' word)* targs? | 'infer' ident ('extends' union)? ;
tuple_item = '...'? type | '...'? word '?'? ':' type | type '?' ;
type_ref = ident ('.' word)* targs? ;
obj_type = '{' (member_type ((',' | ';' | ASI) member_type)* (',' | ';' | ASI)?)? '}' ;
member_type = ('readonly' | '-' | '+' | 'static')* (prop_name '?'? annot? | prop_name '?'? sig | sig | 'new' sig | ('get' | 'set') prop_name sig | '[' ident ':' type ']' annot? | '[' ident 'in' type ('as' type)? ']' ('-' | '+')? '?'? annot? ) ;
"""
)

JAVA = r"""
file = annotation* package? (import | ';')* (type_decl | ';')* module? END ;
package = 'package' qualified ';' ;
module = annotation* 'open'? 'module' qualified '{' (('requires' | 'exports' | 'opens' | 'uses' | 'provides') ('transitive' | 'static')* qualified (('to' | 'with') qualified (',' qualified)*)? ';')* '}' ;
import = 'import' 'static'? ident ('.' ident)* ('.' '*')? ';' ;
qualified = ident ('.' ident)* ;
ident = ID | 'record' | 'sealed' | 'permits' | 'var' | 'yield' | 'open' | 'module' | 'requires' | 'exports' | 'opens' | 'uses' | 'provides' | 'to' | 'with' | 'transitive' | 'non-sealed' ;
modifier = annotation | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non-sealed' ;
annotation = '@' qualified ('(' (element_pairs | element_value)? ')')? ;
element_pairs = ident '=' element_value (',' ident '=' element_value)* ;
element_value = expr | annotation | '{' (element_value (',' element_value)*)? ','? '}' ;
type_decl = modifier* (class | interface | enum | record | annotation_type) ;
class = 'class' ident tparams? ('extends' type)? ('implements' types)? ('permits' types)? class_body ;
interface = 'interface' ident tparams? ('extends' types)? ('permits' types)? class_body ;
record = 'record' ident tparams? '(' params? ')' ('implements' types)? class_body ;
enum = 'enum' ident ('implements' types)? '{' (constant (',' constant)*)? ','? (';' member*)? '}' ;
constant = annotation* ident args? class_body? ;
annotation_type = '@' 'interface' ident class_body ;
class_body = '{' member* '}' ;
member = ';' | 'static'? block | modifier* (class | interface | enum | record | annotation_type | field | method | ctor) ;
field = type declarator (',' declarator)* ';' ;
declarator = ident dims ('=' init)? ;
dims = (annotation* '[' ']')* ;
init = expr | array_init ;
array_init = '{' (init (',' init)*)? ','? '}' ;
method = tparams? (type | 'void') ident '(' params? ')' dims throws? (block | 'default' element_value ';' | ';') ;
ctor = tparams? ident ('(' params? ')')? throws? block ;
throws = 'throws' types ;
params = param (',' param)* ;
param = ('final' | annotation)* type (annotation* '...')? (ident dims | (ident '.')? 'this') ;
tparams = '<' tparam (',' tparam)* '>' ;
tparam = annotation* ident ('extends' type ('&' type)*)? ;
types = type (',' type)* ;
type = annotation* (PRIM | class_type) dims ;
class_type = ident targs? ('.' annotation* ident targs?)* ;
targs = '<' (targ (',' targ)*)? '>' ;
targ = type | annotation* '?' (('extends' | 'super') type)? ;
block = '{' block_stmt* '}' ;
block_stmt = ('final' | annotation)* type declarator (',' declarator)* ';' | modifier* (class | interface | enum | record) | stmt ;
stmt = block | ';' | stmt_expr ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' for_head ')' stmt | ident ':' stmt
  | 'return' expr? ';' | 'break' ident? ';' | 'continue' ident? ';' | 'throw' expr ';' | 'yield' expr ';' | 'assert' expr (':' expr)? ';' | 'synchronized' '(' expr ')' block
  | 'try' ('(' resource (';' resource)* ';'? ')')? block ('catch' '(' ('final' | annotation)* class_type ('|' class_type)* ident ')' block)* ('finally' block)? | switch ;
resource = ('final' | annotation)* type ident '=' expr | primary ;
for_head = (('final' | annotation)* type declarator (',' declarator)* | stmt_expr (',' stmt_expr)*)? ';' expr? ';' (stmt_expr (',' stmt_expr)*)? | ('final' | annotation)* type ident dims ':' expr ;
stmt_expr = primary ('=' | ASSIGN) expr | INC primary | primary INC | call ;
call = head? (ident | 'this' | 'super') targs? args class_body? | 'new' creator | head 'new' creator | head targs ident args ;
head = atom (suffix)* '.' | atom suffix* '::' ;
switch = 'switch' '(' expr ')' '{' switch_item* '}' ;
switch_item = label ':' block_stmt* | ('case' case_values | 'default') '->' (block | expr ';' | 'throw' expr ';') ;
label = 'case' case_values | 'default' ;
case_values = case_value (',' case_value)* ;
case_value = flat | 'default' | type ident ;
expr = lambda | primary ('=' | ASSIGN) expr | flat ('?' expr ':' (lambda | expr))? ;
lambda = (ident | '(' (ident (',' ident)* | params)? ')') '->' (expr | block) ;
flat = unary (binop unary | 'instanceof' 'final'? type (ident)?)* ;
binop = BINOP | '<' | '>' | '-' | '+' | '&' | '|' | '*' | '>' '>' | '>' '>' '>' ;
unary = ('-' | '+' | '!' | '~' | INC | cast)* (primary INC* | lambda) ;
cast = '(' type ('&' type)* ')' ;
primary = atom suffix* ;
atom = ident | NUM | STR | CHAR | 'true' | 'false' | 'null' | 'this' | 'super' | '(' expr ')' | 'new' creator | switch | ident args | 'this' args | 'super' args | type '::' (ident | 'new') | (PRIM | class_type | 'void') dims '.' 'class' ;
suffix = '.' (ident args? | 'this' | 'class' | 'new' creator | targs ident args | 'super' args?) | '[' expr ']' | '::' targs? (ident | 'new') ;
args = '(' (expr (',' expr)*)? ')' ;
creator = annotation* (class_type (args class_body?) | (PRIM | class_type) ((annotation* '[' expr ']')+ dims | (annotation* '[' ']')+ array_init)) ;
"""

GO = r"""
file = 'package' ID ';' (import ';')* (top ';')* END ;
import = 'import' (import_spec | '(' (import_spec (';' import_spec)* ';'?)? ')') ;
import_spec = ('.' | ID)? STR ;
top = decl | func ;
decl = 'const' (const_spec | '(' (const_spec (';' const_spec)* ';'?)? ')') | 'type' (type_spec | '(' (type_spec (';' type_spec)* ';'?)? ')') | 'var' (var_spec | '(' (var_spec (';' var_spec)* ';'?)? ')') ;
const_spec = ids (type? '=' exprs)? ;
var_spec = ids (type ('=' exprs)? | '=' exprs) ;
type_spec = ID tparams? '='? type ;
ids = ID (',' ID)* ;
tparams = '[' tparam (',' tparam)* ','? ']' ;
tparam = ids constraint ;
constraint = term ('|' term)* ;
term = '~'? type ;
func = 'func' ('(' params? ')')? ID tparams? sig block? ;
sig = '(' params? ')' (type | '(' params? ')')? ;
params = param (',' param)* ','? ;
param = ID? '...'? type | ID '...' type ;
type = type_name targs? | '*' type | '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | '<-' 'chan' type | 'func' sig | struct | interface | '(' type ')' ;
type_name = ID ('.' ID)? ;
targs = '[' type (',' type)* ','? ']' ;
struct = 'struct' '{' (field (';' field)* ';'?)? '}' ;
field = (ids type | '*'? type_name targs?) STR? ;
interface = 'interface' '{' (elem (';' elem)* ';'?)? '}' ;
elem = ID sig | constraint ;
block = '{' stmts '}' ;
stmts = stmt? (';' stmt?)* ;
stmt = decl | block | simple | 'return' exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | 'go' expr | 'defer' expr | if | for | switch | select | ID ':' stmt? ;
simple = expr (INC | '<-' expr)? | exprs (ASSIGN | '=' | ':=') exprs ;
simple_n = expr_n (INC | '<-' expr_n)? | exprs_n (ASSIGN | '=' | ':=') exprs_n ;
if = 'if' (simple_n? ';')? expr_n block ('else' (if | block))? ;
for = 'for' (expr_n | simple_n? ';' expr_n? ';' simple_n? | (exprs_n (':=' | '='))? 'range' expr_n)? block ;
switch = 'switch' (simple_n? ';')? (simple_n | (ID ':=')? primary_n '.' '(' 'type' ')')? '{' (('case' cases | 'default') ':' stmts)* '}' ;
cases = (expr | type) (',' (expr | type))* ;
select = 'select' '{' (('case' simple_comm | 'default') ':' stmts)* '}' ;
simple_comm = expr ('<-' expr)? | exprs ('=' | ':=') expr ;
exprs = expr (',' expr)* ;
exprs_n = expr_n (',' expr_n)* ;
expr = unary (binop unary)* ;
expr_n = unary_n (binop unary_n)* ;
binop = BINOP | '*' | '-' | '+' | '&' | '|' | '^' ;
unary = ('-' | '+' | '!' | '^' | '*' | '&' | '<-' | '~')* primary ;
unary_n = ('-' | '+' | '!' | '^' | '*' | '&' | '<-' | '~')* primary_n ;
primary = operand suffix* ;
primary_n = operand_n suffix_n* ;
operand = NUM | STR | CHAR | ID | '(' (expr | type) ')' | 'func' sig block? | lit_type lit | type_conv ;
operand_n = NUM | STR | CHAR | ID | '(' (expr | type) ')' | 'func' sig block? | lit_type lit | type_conv ;
lit_type = '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | struct ;
type_conv = ('[' ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | '<-' 'chan' type | interface | struct | '[' expr ']' type) ;
suffix = suffix_n | lit ;
suffix_n = '.' (ID | '(' (type | 'type') ')') | '[' (index (',' index)* ','? | expr? ':' expr? (':' expr?)?) ']' | '(' (arg (',' arg)* ','?)? ')' ;
index = expr | type ;
arg = (expr | type) '...'? ;
lit = '{' (element (',' element)* ','?)? '}' ;
element = (value ':')? value ;
value = expr | lit ;
"""

RUST = r"""
file = SHEBANG? inner* item* END ;
inner = '#' '!' '[' tree* ']' ;
attr = '#' '[' tree* ']' ;
tree = ANY_TOKEN | '(' tree* ')' | '[' tree* ']' | '{' tree* '}' ;
vis = 'pub' ('(' ('in' path_s | 'crate' | 'self' | 'super') ')')? | 'crate' ;
item = attr* (vis? decl | macro_item) ;
decl = fn | struct | enum | union | trait | impl | mod | use | const | type_alias | extern ;
macro_item = path_s '!' ident? ('{' tree* '}' | ('(' tree* ')' | '[' tree* ']') ';') ;
ident = ID | 'union' | 'auto' | 'default' | 'macro_rules' | 'raw' ;
fn = 'default'? 'const'? 'async'? 'unsafe'? ('extern' STR?)? 'fn' ident generics? '(' params? ')' ret? where? (block | ';') ;
params = param (',' param)* ','? ;
param = attr* (self_param | pattern ':' type | '...' | type) ;
self_param = ('&' LIFETIME?)? 'mut'? 'self' (':' type)? ;
ret = '->' type ;
where = 'where' (wpred (',' wpred)* ','?)? ;
wpred = LIFETIME ':' lbounds? | for_lt? type ':' bounds? ;
generics = '<' (gparam (',' gparam)* ','?)? '>' ;
gparam = attr* (LIFETIME (':' lbounds)? | 'const' ident ':' type ('=' (block | '-'? literal | ident))? | ident (':' bounds?)? ('=' type)?) ;
lbounds = LIFETIME ('+' LIFETIME)* '+'? ;
bounds = bound ('+' bound)* '+'? ;
bound = LIFETIME | '?'? for_lt? type_path | '(' '?'? for_lt? type_path ')' | '~' 'const' type_path ;
for_lt = 'for' '<' (LIFETIME (',' LIFETIME)* ','?)? '>' ;
struct = 'struct' ident generics? (where? '{' fields? '}' | '(' tuple_fields? ')' where? ';' | where? ';') ;
union = 'union' ident generics? where? '{' fields? '}' ;
fields = field (',' field)* ','? ;
field = attr* vis? ident ':' type ;
tuple_fields = attr* vis? type (',' attr* vis? type)* ','? ;
enum = 'enum' ident generics? where? '{' (variant (',' variant)* ','?)? '}' ;
variant = attr* vis? ident ('{' fields? '}' | '(' tuple_fields? ')')? ('=' expr)? ;
trait = 'unsafe'? 'auto'? 'trait' ident generics? (':' bounds?)? where? '{' inner* assoc* '}' ;
impl = 'default'? 'unsafe'? 'impl' generics? 'const'? ('!'? type 'for')? type where? '{' inner* assoc* '}' ;
assoc = attr* (vis? (fn | const | type_alias) | macro_item) ;
mod = 'unsafe'? 'mod' ident (';' | '{' inner* item* '}') ;
use = 'use' use_tree ';' ;
use_tree = ('::'? path_seg ('::' path_seg)*  ('as' (ident | '_'))?) | (('::'? path_seg ('::' path_seg)*)? '::')? ('*' | '{' (use_tree (',' use_tree)* ','?)? '}') ;
path_seg = ident | 'crate' | 'self' | 'super' ;
path_s = '::'? path_seg ('::' path_seg)* ;
const = 'const' (ident | '_') ':' type ('=' expr)? ';' | 'static' 'mut'? ident ':' type ('=' expr)? ';' ;
type_alias = 'type' ident generics? (':' bounds?)? where? ('=' type)? where? ';' ;
extern = 'unsafe'? 'extern' STR? '{' inner* assoc_ext* '}' | 'extern' 'crate' (ident | 'self') ('as' (ident | '_'))? ';' ;
assoc_ext = attr* (vis? (fn | const | type_alias) | macro_item) ;
type = '(' (type (',' type)* ','?)? ')' | '!' | ('&' | '&&') LIFETIME? 'mut'? type_nb | '*' ('const' | 'mut') type_nb | '[' type (';' expr)? ']' | '_' | fn_type | ('impl' | 'dyn') bounds | for_lt (fn_type | type_path) | type_path ('+' bound)* | qpath | path_s '!' ('(' tree* ')' | '[' tree* ']' | '{' tree* '}') ;
type_nb = '(' (type (',' type)* ','?)? ')' | '!' | ('&' | '&&') LIFETIME? 'mut'? type_nb | '*' ('const' | 'mut') type_nb | '[' type (';' expr)? ']' | '_' | fn_type | ('impl' | 'dyn') bound | for_lt (fn_type | type_path) | type_path | qpath | path_s '!' ('(' tree* ')' | '[' tree* ']' | '{' tree* '}') ;
fn_type = 'unsafe'? ('extern' STR?)? 'fn' '(' (attr* ((ident | '_') ':')? (type | '...') (',' attr* ((ident | '_') ':')? (type | '...'))* ','?)? ')' ('->' type_nb)? ;
type_path = '::'? type_seg ('::' type_seg)* ;
type_seg = (path_seg | 'Self') ('::'? gargs | '(' (type (',' type)* ','?)? ')' ('->' type_nb)?)? ;
qpath = '<' type ('as' type_path)? '>' ('::' type_seg)+ ;
gargs = '<' (garg (',' garg)* ','?)? '>' ;
garg = LIFETIME | type | block | '-'? literal | ident gargs? ('=' type | ':' bounds) ;
literal = NUM | STR | CHAR | 'true' | 'false' ;
pattern = '|'? pat_one ('|' pat_one)* ;
pat_one = '_' | '..' | '-'? literal (range ('-'? literal | expr_path)?)? | range ('-'? literal | expr_path) | ('ref')? 'mut'? ident ('@' pat_one)? | ('&' | '&&') 'mut'? pat_one | '(' (pattern (',' pattern)* ','?)? ')' | '[' (pattern (',' pattern)* ','?)? ']'
  | expr_path (range ('-'? literal | expr_path)?)? | expr_path '(' (pattern (',' pattern)* ','?)? ')' | expr_path '{' (pat_field (',' pat_field)* ','?)? '}' | 'const' block | path_s '!' ('(' tree* ')' | '[' tree* ']') ;
range = '..' | '..=' | '...' ;
pat_field = attr* ((ident | NUM) ':' pattern | 'ref'? 'mut'? ident | '..') ;
expr_path = '::'? expr_seg ('::' expr_seg)* | qpath ;
expr_seg = (path_seg | 'Self') ('::' gargs)? ;
block = '{' inner* stmt* expr? '}' ;
stmt = ';' | let | item | attr* expr ';' | attr* block_like | attr* path_s '!' '{' tree* '}' ;
let = attr* 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';' ;
block_like = label? ('unsafe' | 'async' 'move'? | 'const')? block | if | match | label? 'loop' block | label? 'while' cond block | label? 'for' pattern 'in' expr_n block ;
label = LIFETIME ':' ;
if = 'if' cond block ('else' (block | if))? ;
cond = cond_part ('&&' cond_part)* ;
cond_part = 'let' pattern '=' flat_n | expr_n ;
match = 'match' expr_n '{' inner* arm* '}' ;
arm = attr* pattern ('if' cond_g)? '=>' (block ','? | attr* expr ',' | attr* expr ARM_END | block_like) ;
cond_g = ('let' pattern '=' flat | expr) ('&&' ('let' pattern '=' flat | expr))* ;
expr = flat (('=' | ASSIGN) expr)? | jump ;
expr_n = flat_n (('=' | ASSIGN) expr_n)? | jump_n ;
jump = 'return' expr? | 'break' LIFETIME? expr? | 'continue' LIFETIME? | closure ;
jump_n = 'return' expr_n? | 'break' LIFETIME? expr_n? | 'continue' LIFETIME? | closure_n ;
closure = for_lt? 'static'? 'async'? 'move'? ('||' | '|' (cparam (',' cparam)* ','?)? '|') ('->' type_nb block | expr) ;
closure_n = for_lt? 'static'? 'async'? 'move'? ('||' | '|' (cparam (',' cparam)* ','?)? '|') ('->' type_nb block | expr_n) ;
cparam = attr* pat_one (':' type)? ;
flat = unary (binop (unary | jump))* (('..' | '..=') (unary (binop unary)*)?)? | ('..' | '..=') (unary (binop unary)*)? ;
flat_n = unary_n (binop (unary_n | jump_n))* (('..' | '..=') (unary_n (binop unary_n)*)?)? | ('..' | '..=') (unary_n (binop unary_n)*)? ;
binop = BINOP | '<' | '>' | '-' | '+' | '*' | '&' | '|' | '&&' | '||' | '^' | '>' '>' | '>' '=' | '>' '>' '=' ;
unary = ('-' | '!' | '*' | '&' 'raw'? ('mut' | 'const')? | '&&' 'mut'?)* post ('as' type_nb)* | ('-' | '!' | '*' | '&' 'mut'?)+ closure ;
unary_n = ('-' | '!' | '*' | '&' 'raw'? ('mut' | 'const')? | '&&' 'mut'?)* post_n ('as' type_nb)* ;
post = primary suffix* ;
post_n = primary_n suffix* ;
suffix = '?' | '.' ('await' | NUM | ident ('::' gargs)?) | '(' (attr* expr (',' attr* expr)* ','?)? ')' | '[' expr ']' ;
primary = primary_n | struct_lit ;
primary_n = literal | expr_path | '(' (attr* expr (',' attr* expr)* ','?)? ')' | '[' (expr (',' expr)* ','? | expr ';' expr)? ']' | block_like | path_s '!' ('(' tree* ')' | '[' tree* ']' | '{' tree* '}') | '_' ;
struct_lit = expr_path '{' (lit_field (',' lit_field)* (',' ('..' expr?)?)? | '..' expr)? '}' ;
lit_field = attr* ((ident | NUM) ':' expr | ident) ;
"""
