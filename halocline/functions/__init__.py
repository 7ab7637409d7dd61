"""Column functions: no shuffle, no Python at run time; all stay inside whole-stage code generation."""
