"""Record schemas. Parsers hand over JSON; from_json gives these types."""

from __future__ import annotations

METHOD = "struct<name:string,kind:string,params:array<string>,async:boolean,visibility:string,line:int>"
PARAM = "struct<mode:string,name:string,type:string>"
REFERENCE = "struct<table:string,columns:array<string>,onDelete:string,onUpdate:string>"
CONSTRAINT = f"struct<constraintType:string,constraint:string,definition:array<string>,reference:{REFERENCE}>"
PAIR = "struct<key:string,value:string>"
DEPENDENCY = "struct<name:string,version:string,path:string,git:string,branch:string,tag:string,rev:string,package:string,registry:string,features:array<string>,optional:boolean,defaultFeatures:boolean,workspace:boolean>"
DEPENDENCIES = f"array<struct<key:string,value:array<{DEPENDENCY}>>>"

FACTS = {
    "imports": "struct<type:string,source:string,alias:string,specifiers:array<struct<kind:string,imported:string,local:string>>,line:int,spec:string>",
    "exports": "struct<name:string,kind:string,source:string,original:string,line:int>",
    "functions": f"struct<name:string,kind:string,params:array<string>,async:boolean,line:int,returnType:string,routineParams:array<{PARAM}>>",
    "classes": f"struct<name:string,kind:string,extends:string,methods:array<{METHOD}>,fields:array<string>,constants:array<struct<name:string,value:string,visibility:string,line:int>>,line:int>",
    "routes": "struct<method:string,path:string,line:int>",
    "tables": f"struct<name:string,ifNotExists:boolean,columns:array<struct<name:string,type:string,length:string,nullable:boolean,default:string,autoIncrement:boolean,primary:boolean,unique:boolean,comment:string>>,primaryKey:array<{CONSTRAINT}>,foreignKeys:array<{CONSTRAINT}>,uniqueConstraints:array<{CONSTRAINT}>,check:array<{CONSTRAINT}>,indexes:array<struct<name:string,definition:array<string>,type:string>>>",
    "views": "struct<name:string,select:string>",
    "indexes": "struct<name:string,table:string,columns:array<string>,type:string,using:string>",
    "storedProcedures": f"struct<name:string,params:array<{PARAM}>>",
    "triggers": "struct<name:string,timing:string,event:string,table:string>",
    "databases": "struct<name:string>",
    "inserts": "struct<table:string,columns:array<string>,values:string>",
    "updates": f"struct<table:string,set:array<struct<column:string,value:string>>,where:string>",
    "deletes": "struct<from:array<string>,where:string>",
    "selects": "struct<columns:array<struct<column:string,alias:string>>,from:array<string>,joins:array<struct<type:string,table:string,on:string>>,where:string,groupBy:array<string>,having:string,orderBy:array<string>,limit:string,distinct:boolean>",
    "alterTables": f"struct<table:string,operations:array<struct<action:string,resource:string,column:string,definition:string,nullable:boolean,newName:string,constraint:string,constraintType:string,columns:array<string>,reference:{REFERENCE}>>>",
    "drops": "struct<names:array<string>,keyword:string>",
    "comments": "struct<type:string,content:string,line:int>",
}
DETAIL = (
    "struct<dialect:string,projects:array<struct<name:string,path:string,type:string>>,packages:array<struct<name:string,version:string,hintPath:string,targetFramework:string>>,"
    "projectReferences:array<struct<path:string>>,framework:string,sdk:string,outputType:string,connectionStrings:array<struct<name:string,connectionString:string,providerName:string>>,"
    f"appSettings:array<{PAIR}>,uiComponents:array<struct<type:string,name:string,parentType:string,line:int>>,sections:array<struct<name:string,keys:array<{PAIR}>>>,"
    "package:struct<name:string,version:string,edition:string,description:string,license:string,licenseFile:string,repository:string,homepage:string,documentation:string,readme:string,rustVersion:string,"
    "links:string,resolver:string,defaultRun:string,authors:array<string>,keywords:array<string>,categories:array<string>,exclude:array<string>,include:array<string>,publish:string,build:string>,"
    f"dependencies:struct<normal:array<{DEPENDENCY}>,dev:array<{DEPENDENCY}>,build:array<{DEPENDENCY}>>,features:array<struct<key:string,value:array<string>>>,profiles:array<{PAIR}>,"
    f"workspace:struct<members:array<string>,exclude:array<string>,resolver:string,dependencies:array<{DEPENDENCY}>>,buildTargets:array<{PAIR}>,patches:{DEPENDENCIES},platformDeps:{DEPENDENCIES},"
    "lockfileVersion:int,lockPackages:array<struct<name:string,version:string,source:string,checksum:string,dependencies:array<struct<name:string,version:string>>>>,rootPackage:string,"
    f"channel:string,components:array<string>,targets:array<string>,profile:string,cargoBuild:string,net:string,registries:array<{PAIR}>,aliases:array<{PAIR}>,configTargets:array<{PAIR}>>"
)
RECORD = "struct<" + ",".join(f"{k}:array<{v}>" for k, v in FACTS.items()) + f",detail:{DETAIL}>"
