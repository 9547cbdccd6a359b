"""Grammars of the scanned languages, in the notation of ``derivative.Grammar``.

They accept what a parser of the current edition accepts as syntax; names, types
and imports play no part.  Where a language's own grammar would need more than one
token of context (declarations against expressions in C, generics against
comparisons, composite literals against blocks) both readings are kept side by side.
"""

_JS_WORDS = """break case catch class const continue debugger default delete do else export extends finally for
function if import in instanceof new return super switch this throw try typeof var void while with null true false enum yield await"""
_JS_SOFT = """async of get set static let as from type interface namespace module declare abstract readonly keyof infer is
asserts unique public private protected override satisfies accessor implements undefined target global using out"""

ECMASCRIPT = """
program = {item} ;
item = stmt | importdecl | exportdecl ;
eos = ';' | NL ;
block = '{' {stmt} '}' ;
stmt = block | ';' | vardecl eos | classdecl | funcdecl | 'if' '(' expr ')' stmt ['else' stmt] | fors
  | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' [';'] | 'continue' [id] eos | 'break' [id] eos
  | 'return' [expr] eos | 'throw' expr eos | trys | switchs | id ':' stmt | 'debugger' eos | exprstmt
  | 'with' '(' expr ')' stmt ;
exprstmt = !('{' | 'function' | 'class') expr eos ;
fors = 'for' ['await'] '(' [vardecl | expr] ';' [expr] ';' [expr] ')' stmt
  | 'for' ['await'] '(' (varkind target tann | lhs) ('in' expr | 'of' assign) ')' stmt ;
trys = 'try' block ('catch' ['(' target tann ')'] block ['finally' block] | 'finally' block) ;
switchs = 'switch' '(' expr ')' '{' {('case' expr | 'default') ':' {stmt}} '}' ;
varkind = 'var' | 'let' | 'const' | 'using' ;
vardecl = varkind binding {',' binding} ;
binding = target bang tann ['=' assign] ;
target = id | arrpat | objpat ;
arrpat = '[' [patel] {',' [patel]} ']' ;
patel = ['...'] target ['=' assign] ;
objpat = '{' [patprop {',' patprop} [',']] '}' ;
patprop = '...' target | propname ':' target ['=' assign] | id ['=' assign] ;
propname = name | STR | NUM | '[' assign ']' | PRIVATE ;
funcdecl = ['async'] 'function' ['*'] id tparams params rann fbody ;
funcexpr = ['async'] 'function' ['*'] [id] tparams params rann fbody ;
params = '(' [param {',' param} [',']] ')' ;
param = {decorator} pmods ['...'] target opt tann ['=' assign] ;
fbody = '{' {stmt} '}' ;
decorator = '@' lhs ;
classdecl = {decorator} cmods 'class' id tparams ctail ;
classexpr = {decorator} 'class' [id] tparams ctail ;
ctail = ['extends' lhs targs] impls '{' {member} '}' ;
member = ';' | {decorator} {mod} propname opt tparams params rann mbody | {decorator} {mod} propname opt bang tann ['=' assign] eos | 'static' block ;
mbody = fbody ;
mod = 'static' | 'async' | 'get' | 'set' | '*' | 'accessor' ;
expr = assign {',' assign} ;
assign = arrow | 'yield' ['*'] [assign] | cond [asgop assign] ;
asgop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>' '>=' | '>' '>' '>=' | '&=' | '^=' | '|=' | '&&=' | '||=' | '??=' ;
arrow = ['async'] (id | tparams params rann) '=>' (fbody | !('{') assign) ;
cond = bin ['?' assign ':' assign] ;
bin = unary {binrest} ;
binrest = binop unary ;
binop = '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '??' | '&' | '|' | '^'
  | '<<' | '>' '>' ['>'] | 'instanceof' | 'in' ;
unary = ('+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await') unary | lhs ['++' | '--'] ;
lhs = {'new'} primary {suffix} ;
suffix = '.' (name | PRIVATE) | '?.' (name | PRIVATE | args | '[' expr ']' | TMPL) | '[' expr ']' | args | TMPL ;
args = '(' [arg {',' arg} [',']] ')' ;
arg = ['...'] assign ;
primary = 'this' | id | NUM | STR | TMPL | REGEX | 'null' | 'true' | 'false' | '[' [arg] {',' [arg]} ']' | object | funcexpr | classexpr
  | '(' expr ')' | 'super' | 'import' args | 'import' '.' name | 'new' '.' name | PRIVATE ;
object = '{' [objprop {',' objprop} [',']] '}' ;
objprop = '...' assign | propname ':' assign | id ['=' assign] | {mod} propname tparams params rann fbody ;
importdecl = 'import' STR [attrs] eos | 'import' itype impclause 'from' STR [attrs] eos ;
attrs = 'with' object ;
impclause = id [',' (ns | named)] | ns | named ;
ns = '*' 'as' id ;
named = '{' [spec {',' spec} [',']] '}' ;
spec = itype modname ['as' modname] ;
modname = name | STR ;
exportdecl = 'export' ('*' ['as' modname] 'from' STR [attrs] eos | itype named ['from' STR [attrs]] eos | vardecl eos | classdecl | funcdecl
  | 'default' (funcexpr | classexpr | !('function' | 'class') assign eos)) ;
""" + "id = IDENT | " + " | ".join(f"'{w}'" for w in _JS_SOFT.split()) + " ;\nname = id | " + " | ".join(f"'{w}'" for w in _JS_WORDS.split()) + " ;\n"

JAVASCRIPT = ECMASCRIPT + """
tann = ; rann = ; tparams = ; targs = ; opt = ; bang = ; itype = ; impls = ; cmods = ; pmods = ;
"""

TYPESCRIPT = ECMASCRIPT + """
tann = [':' type] ;
rann = [':' rtype] ;
rtype = type | (id | 'this') 'is' type | 'asserts' (id | 'this') ['is' type] ;
tparams = [typeparams] ;
typeparams = '<' tparam {',' tparam} [','] '>' ;
tparam = {'const' | 'in' | 'out'} id ['extends' type] ['=' type] ;
targs = [typeargs] ;
typeargs = '<' type {',' type} '>' ;
opt = ['?'] ;
bang = ['!'] ;
itype = ['type'] ;
impls = ['implements' typeref {',' typeref}] ;
cmods = {'abstract' | 'declare'} ;
pmods = {'public' | 'private' | 'protected' | 'readonly' | 'override'} ;
param = 'this' tann ;
mod = 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'abstract' | 'declare' ;
mbody = eos ;
suffix = typeargs args | typeargs TMPL | '!' ;
primary = id typeargs ;
unary = '<' type '>' unary ;
binrest = ('as' | 'satisfies') (type | 'const') ;
stmt = interface | alias | enumd | nsd | 'declare' (vardecl eos | classdecl | funcsig | interface | alias | enumd | nsd | 'global' block) | funcsig ;
funcsig = ['async'] 'function' id tparams params rann eos ;
interface = 'interface' id tparams ['extends' typeref {',' typeref}] '{' {tmember} '}' ;
alias = 'type' id tparams '=' type eos ;
enumd = ['const'] 'enum' id '{' [enumv {',' enumv} [',']] '}' ;
enumv = propname ['=' assign] ;
nsd = ('namespace' | 'module') (id {'.' id} | STR) '{' {item} '}' ;
exportdecl = 'export' (interface | alias | enumd | nsd | 'declare' stmt | funcsig | '=' expr eos | 'default' interface | 'import' id '=' expr eos | 'as' 'namespace' id eos) ;
importdecl = 'import' itype id '=' expr eos ;
type = funtype | utype ['extends' utype '?' type ':' type] ;
funtype = ['abstract'] ['new'] tparams params '=>' rtype ;
utype = ['|' | '&'] ptype {('|' | '&') ptype} ;
ptype = {'keyof' | 'readonly' | 'unique' | 'infer'} tprim {'[' [type] ']'} ;
typeref = id {'.' name} targs ;
tprim = typeref | 'typeof' ('this' | id | 'import' args) {'.' name} targs | 'import' args {'.' name} targs | STR | NUM | '-' NUM | TMPL | 'true' | 'false' | 'null'
  | 'void' | 'this' | '{' {tmember} '}' | '[' [tupel {',' tupel} [',']] ']' | '(' type ')' ;
tupel = ['...'] [id ['?'] ':'] type ['?'] ;
tmember = (tsig | '[' id 'in' type ['as' type] ']' ['?' | '-' '?' | '+' '?'] tann | ('+' | '-') 'readonly' '[' id 'in' type ']' ['?' | '-' '?'] tann | 'readonly' '[' id 'in' type ']' ['?' | '-' '?'] tann) (';' | ',' | NL) ;
tsig = {'readonly' | 'get' | 'set'} propname ['?'] tann | {'get' | 'set'} propname ['?'] tparams params rann | ['new'] tparams params rann
  | {'readonly' | 'static'} '[' id ':' type ']' tann ;
member = {mod} '[' id ':' type ']' tann eos ;
"""

GO = """
file = {';'} 'package' IDENT ';' {imp ';'} {top ';'} ;
imp = 'import' (ispec | '(' [ispec {';' ispec} [';']] ')') ;
ispec = ['.' | IDENT] STR ;
top = decl | func ;
decl = 'const' (cspec | '(' [cspec {';' cspec} [';']] ')') | 'var' (vspec | '(' [vspec {';' vspec} [';']] ')')
  | 'type' (tspec | '(' [tspec {';' tspec} [';']] ')') ;
ids = IDENT {',' IDENT} ;
cspec = ids [[type] '=' exprs] ;
vspec = ids (type ['=' exprs] | '=' exprs) ;
tspec = IDENT [tparams] ['='] type ;
tparams = '[' tpar {',' tpar} [','] ']' ;
tpar = ids union ;
union = ['~'] type {'|' ['~'] type} ;
func = 'func' [params] IDENT [tparams] sig [block] ;
params = '(' [pdecl {',' pdecl} [',']] ')' ;
pdecl = ['...'] type | IDENT ['...'] type ;
sig = params [params | type] ;
qual = IDENT ['.' IDENT] ;
type = qual ['[' type {',' type} [','] ']'] | typelit | '(' type ')' ;
typelit = '*' type | '[' ['...' | expr] ']' type | 'map' '[' type ']' type | 'chan' ['<-'] type | '<-' 'chan' type | 'func' sig
  | 'struct' '{' [field {';' field} [';']] '}' | 'interface' '{' [elem {';' elem} [';']] '}' ;
field = ids type [STR] | ['*'] qual ['[' type {',' type} ']'] [STR] ;
elem = IDENT sig | union ;
block = '{' stmts '}' ;
stmts = [stmt] {';' [stmt]} ;
stmt = simple | decl | ('go' | 'defer') expr | 'return' [exprs] | ('break' | 'continue') [IDENT] | 'goto' IDENT | 'fallthrough' | block | ifs
  | 'switch' [[simple] ';'] [simple] '{' {('case' exprs | 'default') ':' stmts} '}' | 'select' '{' {('case' simple | 'default') ':' stmts} '}'
  | 'for' [forhead] block | IDENT ':' [stmt] ;
ifs = 'if' [[simple] ';'] expr block ['else' (ifs | block)] ;
forhead = expr | [simple] ';' [expr] ';' [simple] | [exprs (':=' | '=')] 'range' expr ;
simple = exprs ['++' | '--' | asgop exprs | ':=' exprs | '<-' expr] ;
asgop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ;
exprs = expr {',' expr} ;
expr = unary {binop unary} ;
binop = '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^' ;
unary = {'+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~'} operand {suffix} ;
operand = NUM | STR | CHAR | IDENT | IDENT ['.' IDENT] ['[' type {',' type} ']'] litbody | '(' expr ')' | 'func' sig block | typeop [litbody] ;
typeop = '[' ['...' | expr] ']' type | 'map' '[' type ']' type | 'chan' ['<-'] type | 'struct' '{' [field {';' field} [';']] '}'
  | 'interface' '{' [elem {';' elem} [';']] '}' | 'func' sig ;
litbody = '{' [lit {',' lit} [',']] '}' ;
lit = litv [':' litv] ;
litv = expr | litbody ;
suffix = '.' IDENT | '.' '(' ('type' | type) ')' | '[' [expr] {':' [expr]} ']' | '[' type {',' type} [','] ']' | '(' [expr {',' expr} ['...'] [',']] ')' ;
"""

_RUST_TOKENS = """IDENT LIFE NUM STR CHAR""".split()
RUST_WORDS = """as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return
self Self static struct super trait true type unsafe use where while _ macro_rules union"""
RUST_OPS = """+ - * / % ^ ! & | && || << > >= <= < += -= *= /= %= ^= &= |= <<= = == != @ . .. ... ..= , ; : :: -> => # $ ? ~"""

RUST = """
file = {inner} {item} ;
attr = '#' '[' {tt} ']' ;
inner = '#' '!' '[' {tt} ']' ;
item = {attr} (vis itemk | macitem) ;
vis = ['pub' ['(' {tt} ')']] ;
itemk = fnd | 'struct' IDENT [generics] structrest | 'enum' IDENT [generics] [where] '{' [variant {',' variant} [',']] '}'
  | 'union' IDENT [generics] [where] '{' fields '}' | ['unsafe'] 'trait' IDENT [generics] [':' bounds] [where] '{' {inner} {item} '}'
  | ['unsafe'] 'impl' [generics] ['!'] type ['for' type] [where] '{' {inner} {item} '}' | ['unsafe'] 'mod' IDENT (';' | '{' {inner} {item} '}')
  | 'use' usetree ';' | 'const' (IDENT | '_') ':' type ['=' expr] ';' | 'static' ['mut'] IDENT ':' type ['=' expr] ';'
  | 'type' IDENT [generics] [':' bounds] [where] ['=' type] [where] ';' | ['unsafe'] 'extern' [STR] '{' {inner} {item} '}' | 'extern' 'crate' (IDENT | 'self') ['as' (IDENT | '_')] ';' ;
macitem = 'macro_rules' '!' IDENT (brace | paren ';' | brack ';') | path '!' (brace | paren ';' | brack ';') ;
brace = '{' {tt} '}' ; paren = '(' {tt} ')' ; brack = '[' {tt} ']' ;
structrest = [where] '{' fields '}' | '(' [tfield {',' tfield} [',']] ')' [where] ';' | [where] ';' ;
fields = [field {',' field} [',']] ;
field = {attr} vis IDENT ':' type ;
tfield = {attr} vis type ;
variant = {attr} vis IDENT ['{' fields '}' | '(' [tfield {',' tfield} [',']] ')'] ['=' expr] ;
usetree = ['::'] [upath '::'] ('*' | '{' [usetree {',' usetree} [',']] '}') | ['::'] upath ['as' (IDENT | '_')] ;
upath = useg {'::' useg} ;
useg = IDENT | 'self' | 'super' | 'crate' | 'Self' | '$' 'crate' ;
fnd = {'const' | 'async' | 'unsafe'} ['extern' [STR]] 'fn' IDENT [generics] '(' [fparam {',' fparam} [',']] ')' ['->' type] [where] (block | ';') ;
fparam = {attr} (['&' [LIFE]] ['mut'] 'self' [':' type] | pat ':' type | '...') ;
generics = '<' [gpar {',' gpar} [',']] '>' ;
gpar = {attr} (LIFE [':' bounds] | IDENT [':' bounds] ['=' type] | 'const' IDENT ':' type ['=' (NUM | block | IDENT)]) ;
bounds = [bound {'+' bound} ['+']] ;
bound = LIFE | ['?' | '~' 'const'] ['for' generics] tpath | '(' ['?'] ['for' generics] tpath ')' ;
where = 'where' [wpred {',' wpred} [',']] ;
wpred = LIFE ':' bounds | ['for' generics] type ':' bounds ;
type = tpath ['!' (paren | brack | brace)] | ('&' | '&&') [LIFE] ['mut'] type | '*' ('const' | 'mut') type | '[' type [';' expr] ']' | '(' [type {',' type} [',']] ')'
  | ['for' generics] {'unsafe'} ['extern' [STR]] 'fn' '(' [ftype {',' ftype} [',']] ')' ['->' type] | 'impl' bounds | 'dyn' bounds | '!' | '_' ;
ftype = [(IDENT | '_') ':'] type | '...' ;
tpath = ['::'] tseg {'::' tseg} | '<' type ['as' tpath] '>' '::' tseg {'::' tseg} ;
tseg = seg [['::'] gargs | ['::'] '(' [type {',' type} [',']] ')' ['->' type]] ;
seg = IDENT | 'self' | 'Self' | 'super' | 'crate' | 'union' | '$' 'crate' ;
gargs = '<' [garg {',' garg} [',']] '>' ;
garg = LIFE | type | ['-'] NUM | STR | CHAR | 'true' | 'false' | block | IDENT [gargs] ('=' type | ':' bounds) ;
path = ['::'] eseg {'::' (eseg | gargs)} | '<' type ['as' tpath] '>' '::' eseg {'::' (eseg | gargs)} ;
eseg = seg ;
block = '{' {inner} {stmt} [expr] '}' ;
stmt = ';' | {attr} 'let' pat [':' type] ['=' expr ['else' block]] ';' | item | {attr} blocklike | {attr} expr ';' ;
blocklike = {'unsafe' | 'async' | 'move' | 'const'} block | ifs | 'match' expr '{' {inner} [arm] '}' | [LIFE ':'] ('loop' block | 'while' expr block | 'for' pat 'in' expr block | block) ;
ifs = 'if' expr block ['else' (ifs | block)] ;
arm = {attr} pat ['if' expr] '=>' (expr [',' [arm]] | blocklike [','] [arm]) ;
expr = rng [asgop expr] ;
asgop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<=' | '>' '>=' ;
rng = bin [('..' | '..=') [bin]] | ('..' | '..=') [bin] ;
bin = unary {binop unary} ;
binop = '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '&&' | '||' | '<<' | '>' '>' | '==' | '!=' | '<' | '>' | '<=' | '>=' ;
unary = {'-' | '!' | '*' | ('&' | '&&') ['mut']} primary {suffix} {'as' type} ;
suffix = '.' (IDENT | 'union') ['::' gargs] | '.' NUM | '.' 'await' | '(' [expr {',' expr} [',']] ')' | '[' expr ']' | '?' ;
primary = NUM | STR | CHAR | 'true' | 'false' | path [slit] | path '!' (paren | brack | brace) | '(' [expr {',' expr} [',']] ')' | '[' [expr (';' expr | {',' expr} [','])] ']'
  | blocklike | closure | 'return' [expr] | 'break' [LIFE] [expr] | 'continue' [LIFE] | 'let' pat '=' bin | '_' ;
slit = '{' [sfield {',' sfield} [',' ['..' [expr]]] | '..' expr] '}' ;
sfield = {attr} (IDENT | NUM) [':' expr] ;
closure = ['for' generics] {'static' | 'async' | 'move'} ('||' | '|' [cpar {',' cpar} [',']] '|') ('->' type block | expr) ;
cpar = p1 [':' type] ;
pat = ['|'] p1 {'|' p1} ;
p1 = ['ref'] ['mut'] IDENT ['@' pat] | plit [('..=' | '..' | '...') [plit]] | ('..=' | '..') plit | path ['(' [pat {',' pat} [',']] ')' | '{' [pfield {',' pfield} [',']] '}']
  | path '!' (paren | brack | brace) | ('&' | '&&') ['mut'] p1 | '(' [pat {',' pat} [',']] ')' | '[' [pat {',' pat} [',']] ']' | '_' | '..' | 'const' block ;
plit = ['-'] NUM | STR | CHAR | 'true' | 'false' | path ;
pfield = {attr} ('..' | ['ref'] ['mut'] IDENT | (IDENT | NUM) ':' pat) ;
""" + "tt = paren | brack | brace | " + " | ".join([*_RUST_TOKENS, *(f"'{w}'" for w in (RUST_WORDS + " " + RUST_OPS).split())]) + " ;\n"

JAVA = """
file = [{annot} 'package' qname ';'] {import | ';'} {typedecl | ';'} | {import | ';'} {cmember} | {import | ';'} modd ;
modd = {annot} ['open'] 'module' qname '{' {IDENT {IDENT | 'to' | 'with' | '.' | ',' | 'static' | 'transitive'} ';'} '}' ;
qname = id {'.' id} ;
import = 'import' ['static' | 'module'] qname ['.' '*'] ';' ;
annot = '@' qname ['(' [aval | id '=' aval {',' id '=' aval}] ')'] ;
aval = tern | annot | '{' [aval {',' aval}] [','] '}' ;
mod = annot | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default'
  | 'sealed' | 'non' '-' 'sealed' ;
typedecl = {mod} typekind ;
typekind = 'class' id [tparams] ['extends' type] ['implements' types] ['permits' types] cbody
  | 'interface' id [tparams] ['extends' types] ['permits' types] cbody | '@' 'interface' id cbody
  | 'enum' id ['implements' types] '{' [econst {',' econst}] [','] [';' {cmember}] '}'
  | 'record' id [tparams] '(' [param {',' param}] ')' ['implements' types] cbody ;
econst = {annot} id [args] [cbody] ;
cbody = '{' {cmember} '}' ;
cmember = ';' | ['static'] block | {mod} (typekind | [tparams] (type | 'void') id params {dims} ['throws' types] (block | ['default' aval] ';')
  | [tparams] id params ['throws' types] block | id block | type vdecl {',' vdecl} ';') ;
params = '(' [param {',' param}] ')' ;
param = {mod} type ({annot} '...' id | id {dims} | [id '.'] 'this') ;
tparams = '<' tpar {',' tpar} '>' ;
tpar = {annot} id ['extends' type {'&' type}] ;
types = type {',' type} ;
type = {annot} (prim | ctype) {{annot} dims} ;
dims = '[' ']' ;
prim = 'int' | 'long' | 'short' | 'byte' | 'char' | 'float' | 'double' | 'boolean' ;
ctype = id [targs] {'.' {annot} id [targs]} ;
targs = '<' [targ {',' targ}] '>' ;
targ = type | {annot} '?' [('extends' | 'super') type] ;
vdecl = id {dims} ['=' vinit] ;
vinit = expr | '{' [vinit {',' vinit}] [','] '}' ;
block = '{' {bstmt} '}' ;
bstmt = {mod} type vdecl {',' vdecl} ';' | {mod} typekind | stmt ;
stmt = block | ';' | sexpr ';' | 'if' '(' expr ')' stmt ['else' stmt] | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | fors | id ':' stmt
  | 'switch' '(' expr ')' swbody | 'try' ['(' res {';' res} [';'] ')'] block {'catch' '(' {mod} type {'|' type} id ')' block} ['finally' block] | 'return' [expr] ';'
  | ('break' | 'continue') [id] ';' | 'throw' expr ';' | 'synchronized' '(' expr ')' block | 'assert' expr [':' expr] ';' | 'yield' expr ';' ;
res = {mod} type id '=' expr | id {'.' id} | 'this' '.' id ;
fors = 'for' '(' [{mod} type vdecl {',' vdecl} | sexpr {',' sexpr}] ';' [expr] ';' [sexpr {',' sexpr}] ')' stmt | 'for' '(' {mod} type id {dims} ':' expr ')' stmt ;
swbody = '{' {label ':' {bstmt}} '}' | '{' {label '->' (expr ';' | block | 'throw' expr ';')} '}' ;
label = 'case' clab {',' clab} ['when' expr] | 'default' ;
clab = tern | pattern | 'default' ;
pattern = {mod} type (id | '_') | {mod} ctype '(' [pattern {',' pattern}] ')' ;
sexpr = unarylhs asgop expr | ('++' | '--') unary | unarylhs ('++' | '--') | primary {suffix} csuffix | primary args | 'new' creator ;
unarylhs = primary {suffix} ;
expr = lambda | tern [asgop expr] ;
asgop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>=' ;
lambda = (id | '(' [id {',' id} | param {',' param}] ')') '->' (expr | block) ;
tern = bin ['?' (tern | lambda) ':' (tern | lambda)] ;
bin = unary {binop unary | 'instanceof' (['final'] type [id] | pattern)} ;
binop = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>' '>' ['>'] ;
unary = ('+' | '-' | '!' | '~' | '++' | '--') unary | '(' type {'&' type} ')' (unary | lambda) | primary {suffix} {'++' | '--'} | 'switch' '(' expr ')' swbody ;
primary = NUM | STR | CHAR | 'true' | 'false' | 'null' | 'this' | 'super' | id | '(' expr ')' | 'new' creator | (prim | 'void') {dims} '.' 'class' | id {'.' id} dims {dims} '.' 'class'
  | type '::' [targs] (id | 'new') | id args ;
creator = [targs] ctype (args [cbody] | {'[' expr ']'} {dims} [ainit]) | prim {'[' expr ']'} {dims} [ainit] ;
ainit = '{' [vinit {',' vinit}] [','] '}' ;
suffix = '.' ([targs] id | 'this' | 'super' | 'class' | 'new' creator) | '[' expr ']' | args | '::' [targs] (id | 'new') ;
csuffix = '.' [targs] id args | args | '.' 'new' creator ;
args = '(' [expr {',' expr}] ')' ;
""" + "id = IDENT | " + " | ".join(f"'{w}'" for w in "record sealed permits var yield when non module open to with transitive _".split()) + " ;\n"

C = """
file = {ext} ;
ext = ';' | decl | specs declarator {decl} block | 'static_assert' '(' expr [',' STR] ')' ';' | 'asm' '(' {STR} ')' ';' ;
attr = '[' '[' {atok} ']' ']' | '__attribute__' '(' '(' {atok} ')' ')' ;
atok = IDENT | STR | NUM | ',' | ':' ':' | '(' {atok} ')' | '=' | 'const' ;
decl = {attr} specs [initd {',' initd}] ';' ;
initd = declarator ['asm' '(' STR ')'] {attr} ['=' init] ;
init = assign | '{' [ielem {',' ielem} [',']] '}' ;
ielem = [{'.' IDENT | '[' cond ['...' cond] ']'} '='] init ;
qual = 'const' | 'volatile' | 'restrict' | 'static' | 'extern' | 'register' | 'auto' | 'typedef' | 'inline' | '_Noreturn' | 'thread_local' | 'constexpr' | '_Atomic' | attr | 'alignas' '(' (typename | expr) ')' ;
specs = {qual} (basic {basic | qual} | tagged {qual} | IDENT {qual}) | qual {qual} ;
basic = 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | 'bool' | '_Complex' ;
tagged = ('struct' | 'union') {attr} ([IDENT] '{' {member} '}' | IDENT) | 'enum' {attr} ([IDENT] [':' specs] '{' [IDENT {attr} ['=' cond] {',' IDENT {attr} ['=' cond]} [',']] '}' | IDENT)
  | ('typeof' | 'typeof_unqual') '(' (typename | expr) ')' | '_Atomic' '(' typename ')' | '_BitInt' '(' expr ')' ;
member = {attr} specs [mdecl {',' mdecl}] ';' | 'static_assert' '(' expr [',' STR] ')' ';' ;
mdecl = declarator [':' cond] {attr} | ':' cond ;
declarator = {'*' {qual}} direct ;
direct = (IDENT | '(' {attr} declarator ')') {attr} {dsuf} ;
dsuf = '[' {qual} ['*' | assign] ']' {attr} | '(' [plist | IDENT {',' IDENT}] ')' {attr} ;
plist = pdecl {',' pdecl} [',' '...'] | '...' ;
pdecl = {attr} specs [declarator | abst] ;
abst = '*' {qual} {'*' {qual}} [absd] | absd ;
absd = ('(' abst ')' | asuf) {asuf} ;
asuf = '[' {qual} ['*' | assign] ']' | '(' [plist] ')' ;
typename = specs [abst] ;
block = '{' {bitem} '}' ;
bitem = decl | stmt | 'static_assert' '(' expr [',' STR] ')' ';' | label ;
label = {attr} (IDENT | 'case' cond ['...' cond] | 'default') ':' ;
stmt = block | [expr] ';' | label stmt | 'if' '(' expr ')' stmt ['else' stmt] | 'switch' '(' expr ')' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' (decl | [expr] ';') [expr] ';' [expr] ')' stmt | 'goto' IDENT ';' | 'continue' ';' | 'break' ';' | 'return' [expr] ';' | 'asm' ['volatile'] '(' {atok | ':'} ')' ';' | attr stmt ;
expr = assign {',' assign} ;
assign = cond [asgop assign] ;
asgop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' ;
cond = bin ['?' [expr] ':' cond] ;
bin = cast {binop cast} ;
binop = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>>' ;
cast = '(' typename ')' cast | unary ;
unary = ('++' | '--') unary | ('&' | '*' | '+' | '-' | '~' | '!' | '&&') cast | ('sizeof' | 'alignof') (unary | '(' typename ')') | primary {suffix} ;
primary = IDENT | NUM | CHAR | strs | '(' expr ')' | '(' block ')' | '(' typename ')' '{' [ielem {',' ielem} [',']] '}' | 'true' | 'false' | 'nullptr'
  | '_Generic' '(' assign {',' (typename | 'default') ':' assign} ')' ;
strs = STR {STR | IDENT} ;
suffix = '[' expr ']' | '(' [arg {',' arg}] ')' | '.' IDENT | '->' IDENT | '++' | '--' ;
arg = assign | typename ;
"""

_PY_SOFT = "match case type _"
PY_WORDS = """False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda
nonlocal not or pass raise return try while with yield"""

PYTHON = """
file = {stmt} ;
stmt = simple {';' simple} [';'] NEWLINE | compound ;
simple = asg | 'del' target {',' target} [','] | 'pass' | 'break' | 'continue' | 'return' [exprs] | 'raise' [expr ['from' expr]] | 'global' id {',' id} | 'nonlocal' id {',' id}
  | 'assert' expr [',' expr] | 'import' dotted ['as' id] {',' dotted ['as' id]} | 'from' ({'.' | '...'} dotted | '.' {'.' | '...'} | '...' {'.' | '...'}) 'import' ('*' | names | '(' names [','] ')')
  | 'type' id [tparams] '=' expr ;
names = id ['as' id] {',' id ['as' id]} ;
dotted = id {'.' id} ;
asg = exprs | targets '=' {targets '='} (exprs | yielde) | yielde | target1 augop (exprs | yielde) | target1 ':' expr ['=' (exprs | yielde)] ;
augop = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' ;
targets = ['*'] target {',' ['*'] target} [','] ;
target = id | primary {suffix} lastsuf | '(' [targets] ')' | '[' [targets] ']' ;
target1 = id | primary {suffix} lastsuf | '(' target1 ')' ;
lastsuf = '.' id | '[' slices ']' ;
yielde = 'yield' ['from' expr | exprs] ;
exprs = sexpr {',' sexpr} [','] ;
sexpr = expr | '*' bor ;
compound = {'@' nexpr NEWLINE} (funcd | classd) | 'if' nexpr suite {'elif' nexpr suite} ['else' suite] | 'while' nexpr suite ['else' suite]
  | ['async'] 'for' targets 'in' exprs suite ['else' suite] | ['async'] 'with' (withs | '(' withs [','] ')') suite
  | 'try' suite ('finally' suite | exc {exc} ['else' suite] ['finally' suite]) | 'match' exprs ':' NEWLINE INDENT caseb {caseb} DEDENT ;
withs = expr ['as' target] {',' expr ['as' target]} ;
exc = 'except' ['*'] [expr ['as' id] | expr ',' expr {',' expr} [',']] suite ;
caseb = 'case' pats ['if' nexpr] suite ;
funcd = ['async'] 'def' id [tparams] '(' [params] ')' ['->' expr] suite ;
classd = 'class' id [tparams] ['(' [args] ')'] suite ;
tparams = '[' tpar {',' tpar} [','] ']' ;
tpar = ['*' | '**'] id [':' expr] ['=' sexpr] ;
params = ppos [',' ptail] [','] | ptail [','] ;
plain = id [':' expr] ;
dflt = id [':' expr] '=' expr ;
plains = plain {',' plain} ;
dflts = dflt {',' dflt} ;
ppos = plains [',' dflts] | dflts | plains ',' '/' [',' plains] [',' dflts] | [plains ','] dflts ',' '/' [',' dflts] ;
ptail = '*' id [':' sexpr] {',' (plain | dflt)} [',' pkw] | '*' ',' (plain | dflt) {',' (plain | dflt)} [',' pkw] | pkw ;
pkw = '**' id [':' expr] ;
suite = ':' (simple {';' simple} [';'] NEWLINE | NEWLINE INDENT stmt {stmt} DEDENT) ;
pats = pat {',' pat} [','] | '*' id {',' pat} [','] ;
pat = orp ['as' id] ;
orp = cp {'|' cp} ;
cp = ['-'] NUM [('+' | '-') NUM] | strs | 'None' | 'True' | 'False' | id {'.' id} ['(' [parg {',' parg} [',']] ')'] | '(' [spat {',' spat} [',']] ')' | '[' [spat {',' spat} [',']] ']'
  | '{' [mpat {',' mpat} [',']] '}' ;
spat = pat | '*' id ;
parg = [id '='] pat ;
mpat = (['-'] NUM [('+' | '-') NUM] | strs | 'None' | 'True' | 'False' | id '.' id {'.' id}) ':' pat | '**' id ;
nexpr = expr | id ':=' expr ;
expr = disj ['if' disj 'else' expr] | 'lambda' [lparams] ':' expr ;
lparams = lpos [',' ltail] [','] | ltail [','] ;
lplains = id {',' id} ;
ldflt = id '=' expr ;
ldflts = ldflt {',' ldflt} ;
lpos = lplains [',' ldflts] | ldflts | lplains ',' '/' [',' lplains] [',' ldflts] | [lplains ','] ldflts ',' '/' [',' ldflts] ;
ltail = '*' id {',' (id | ldflt)} [',' '**' id] | '*' ',' (id | ldflt) {',' (id | ldflt)} [',' '**' id] | '**' id ;
disj = inv {('and' | 'or') inv} ;
inv = {'not'} bor {cmpop bor} ;
cmpop = '==' | '!=' | '<' | '>' | '<=' | '>=' | 'in' | 'not' 'in' | 'is' ['not'] ;
bor = unary {binop unary} ;
binop = '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' ;
unary = {'+' | '-' | '~'} ['await'] primary {suffix} ;
suffix = '.' id | '(' [args] ')' | '[' slices ']' ;
primary = id | 'True' | 'False' | 'None' | '...' | NUM | strs | '(' [yielde | tup] ')' | '[' [tup] ']' | '{' [dicts | sets] '}' ;
tup = snexpr (comp | {',' snexpr} [',']) ;
snexpr = nexpr | '*' bor ;
dicts = kv (comp | {',' kv} [',']) ;
kv = expr ':' expr | '**' bor ;
sets = snexpr (comp | {',' snexpr} [',']) ;
comp = ['async'] 'for' targets 'in' disj {'if' cif} {['async'] 'for' targets 'in' disj {'if' cif}} ;
cif = disj | id ':=' disj | 'lambda' [lparams] ':' disj ;
args = nexpr (comp | {',' arg} [',']) | named {',' arg} [','] ;
arg = nexpr | named ;
named = '*' expr | '**' expr | id '=' expr ;
slices = slice {',' slice} [','] ;
slice = nexpr | '*' bor | [expr] ':' [expr] [':' [expr]] ;
strs = STR {STR} ;
fstring = (yielde | exprs) ['='] [CONV] ;
""" + "id = IDENT | " + " | ".join(f"'{w}'" for w in _PY_SOFT.split()) + " ;\n"
