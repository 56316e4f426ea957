"""Column functions: Column in, Column out, all inside code generation unless said otherwise."""
