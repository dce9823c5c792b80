"""codeloam: lazy DataFrame operators over the relations of code and its history."""
